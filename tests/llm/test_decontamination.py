"""Benchmark search against a plain search over all windows."""

import re

import numpy as np
import pytest

from lagwatch.llm import decontamination as dec

SCHEMA = "item_id long, text string"


def plain_words(text):
    stripped = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (text or "").lower().split())
    return [w for w in stripped if w]


def plain_matches(data, items, n=5, threshold=0.8):
    def runs(w, k):
        return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    texts = [(i, plain_words(t)) for i, t in items]
    texts = [(i, w) for i, w in texts if w]
    held = [set(runs(w, min(n, len(w)))) for _, w in texts]
    weight = {g: 1 + np.log(len(texts) / sum(g in h for h in held)) for h in held for g in h}
    out = []
    for doc, text, _ in data:
        words = plain_words(text)
        for item, w in texts:
            k, size = min(n, len(w)), min(len(w), len(words))
            mine, best = runs(w, k), 0.0
            for s in range(len(words) - size + 1):
                theirs = runs(words[s:s + size], k)
                grams = set(mine) | set(theirs)
                both = sum(weight.get(g, 1 + np.log(len(texts))) * min(mine.count(g), theirs.count(g)) for g in grams)
                all_ = sum(weight.get(g, 1 + np.log(len(texts))) * max(mine.count(g), theirs.count(g)) for g in grams)
                best = max(best, both / all_)
            if best >= threshold - 1e-9:
                out.append((doc, item, round(best, 6)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(prose):
    items = [(100 + k, " ".join(prose[k][1].split()[:25 + k])) for k in range(8)]
    items += [(300, "only three words"), (301, ""), (302, None), (303, "?!"), (304, items[0][1])]
    data = [r for r in prose if r[0] >= 20]
    for k, (_, text) in enumerate(items[:8]):
        w = text.split()
        inside = " ".join(prose[30 + k][1].split()[:20])
        data.append((500 + k, f"{inside} {text.upper()}! {inside}", None))                   # whole
        data.append((510 + k, f"{inside} {' '.join(w[:-2])} {inside}", None))                # a little shorter
        data.append((520 + k, f"{inside} {' '.join(w[:len(w) // 2])} {inside}", None))       # half: clean
        if len(w) > 24:
            data.append((530 + k, " ".join(["***" + x + "," for x in w[:12]] + ["other"] + w[13:]), None))  # one word changed
    data += [(600, "Only THREE, words", None), (601, None, None), (602, "", None), (603, "only three", None), (None, items[1][1], None)]
    return data, items


def test_matches(spark, rows, table):
    data, items = table
    expected = plain_matches(data, items)
    assert {d for d, _, _ in expected} >= {500, 501, 507, 600}
    for block_words in (1_000_000, 60):  # the second takes several passes, with the same weights
        found = dec.matches(rows(data, extra=True), spark.createDataFrame(items, SCHEMA), block_words=block_words).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 6)) for r in found), key=str) == expected
        whole = {(500 + k, 100 + k) for k in range(8)}
        assert whole <= {(r.doc_id, r.item_id) for r in found}
        assert not {r.doc_id for r in found} & set(range(520, 528))


def plain_key(x):
    return (x is None, x or 0)


def test_decontaminate(spark, rows, table, empty):
    data, items = table
    benchmark = spark.createDataFrame(items, SCHEMA)
    docs = rows(data, extra=True)
    bad = {r.doc_id for r in dec.matches(docs, benchmark).collect()}
    kept = dec.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=plain_key) == sorted((d for d, _, _ in data if d not in bad), key=plain_key)
    assert dec.matches(empty, benchmark).collect() == []
    assert dec.decontaminate(docs, spark.createDataFrame([], SCHEMA)).count() == len(data)
    assert dec.matches(docs, spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd(spark, rows, odd):
    items = [(1, "no id here at all"), (2, "same words " * 20), (3, "日本 ŝ x")]
    found = {(r.doc_id, r.item_id) for r in dec.matches(rows(odd), spark.createDataFrame(items, SCHEMA)).collect()}
    assert (None, 1) in found and (9, 2) in found


def test_index_gives_all_within_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints[200:] = prints[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 16), replace=False)) for _ in range(200)], np.uint64)
    for radius in (0, 3, 8, 20):
        index = dec.HammingIndex(prints, radius)
        for value in prints[:60]:
            assert index.within(value) == [i for i, p in enumerate(prints) if int(p ^ value).bit_count() <= radius]
