"""Fill-in-middle forms: the skip list, the SQL twin's rules in plain Python, and restoring."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lagwatch.llm import infilling
from lagwatch.llm.queries import fill_in_middle


def plain(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def test_rows_match_plain_python(spark, rows, prose, odd, tmp_path):
    marked = [(200 + i, t, None) for i, t in enumerate(["a<P>b", "<S>", "x <M> y", "<P", "<<S", "P><S", "<M<", "S>x<P"])]
    data = [*prose, *odd, *marked, *((300 + i, f"<word{i}< >P S>", None) for i in range(60))]
    rows(data, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = fill_in_middle(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((plain(d, t) for d, t, _ in data), key=str)
    assert {r.form for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_texts_come_back(rows, prose):
    out = infilling.fill_in_middle(rows(prose), seed=7)
    back = out.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {d: t for d, t, _ in prose}


def test_empty_table(empty):
    assert infilling.fill_in_middle(empty).collect() == []


def test_every_rank_of_the_skip_list():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 8, 9, 64, 65, 700, 5000):
        lengths = np.array([rng.randint(1, 9) for _ in range(n)], np.int64)
        units = infilling.SkipList(lengths)
        places = np.r_[0, np.cumsum(lengths)].tolist()
        assert [units.place(rank) for rank in range(n + 1)] == places
        assert len(units.lanes) <= 12
        for spans, widths, _ in units.lanes:
            assert spans.sum() == n and widths.sum() == places[-1]


def test_few_links_are_followed():
    units, steps = infilling.SkipList(np.ones(200_000, np.int64)), []
    for rank in range(0, 200_000, 9973):
        followed = 0
        node = at = 0
        for spans, _, below in reversed(units.lanes):
            while node < len(spans) and at + spans[node] <= rank:
                at, node, followed = at + int(spans[node]), node + 1, followed + 1
            if at == rank:
                break
            node = int(below[node])
        steps.append(followed)
    assert max(steps) < 300
