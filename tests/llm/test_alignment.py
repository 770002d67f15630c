"""Alignment of two tokenizers against a plain walk over the common ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lagwatch.llm import alignment
from lagwatch.llm.queries import token_alignment, tokenizer

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def plain_groups(aligner, text):
    """Both id lists cut at the common byte ends, from whole-text encoding."""
    a, b = (np.frombuffer(x, "<u4").tolist() for x in aligner.encoder.whole(text)) if text else ([], [])
    ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]).tolist() if ids else []
                      for ids, table in ((a, aligner.encoder.a_bytes), (b, aligner.encoder.b_bytes)))
    groups, i, j = [], 0, 0
    place_a, place_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        i1, j1 = place_a[end], place_b[end]
        groups.append((a[i:i1], b[j:j1]))
        i, j = i1, j1
    return groups


def plain_rows(aligner, data):
    each = [plain_groups(aligner, text) for _, text, _ in data]
    count = Counter((g[0][-1], g[1][-1]) for groups in each for g in groups)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc, _, _), groups in zip(data, each, strict=True):
        links = [(a[-1], b[-1]) for a, b in groups]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, -1])
def test_rows_match_a_plain_walk(spark, rows, prose, odd, aligner, sent, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    data = [*prose, *odd, (90, "▁ spelled as a space", None), (91, "<s> <|endoftext|> </s>", None), (92, "a\tb\r\n c \n", None)]
    rows(data, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = token_alignment(spark, str(tmp_path))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_rows(aligner, data)


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert token_alignment(spark, str(tmp_path)).collect() == []


def test_runs_encode_as_whole_texts(aligner):
    rng = random.Random(5)
    parts = [" ", "\n", "\t", "\r", "  ", "a", "B", "1", ".", "'", "s", "é", "日", "▁", "\xa0", "\x1c", "　", "\x85", "🙂", "<s>", "the", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(4000)] + [" ", "\n", "a ", "日本" * 400 + "\n a"]
    small = alignment.PairEncoder(A, B, remember=50)  # forgets all the time
    assert small.by_runs
    assert small.encode_many(texts[:2000]) + small.encode_many(texts[2000:]) == [aligner.encoder.whole(t) for t in texts]


def test_cuts_of_random_ends():
    rng = np.random.default_rng(3)
    for _ in range(300):
        stops_a, stops_b, ends_a, ends_b, start = [], [], [], [], 0
        for _ in range(rng.integers(1, 5)):
            size = int(rng.integers(1, 60))
            inner = [np.flatnonzero(rng.random(size - 1) < rng.choice([0.05, 0.5, 0.95])) + 1 for _ in range(2)]
            ends_a.extend(start + np.r_[inner[0], size])
            ends_b.extend(start + np.r_[inner[1], size])
            stops_a.append(len(ends_a))
            stops_b.append(len(ends_b))
            start += size
        a, b = alignment.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(stops_a), np.array(stops_b))
        assert np.array(ends_a)[a - 1].tolist() == np.array(ends_b)[b - 1].tolist() == sorted(set(ends_a) & set(ends_b))


def test_counts_of_another_table(rows, aligner):
    base = alignment.staged(alignment.align(rows([(1, "one two two", None), (2, "two", None)]), A, B), "aligned")
    other = alignment.staged(alignment.align(rows([(3, "two three", None)]), A, B), "aligned")
    (found,) = alignment.count_links(other, alignment.pair_counts(base)).collect()
    assert (found.n_links, found.n_best, found.count_sum) == (2, 1, 3)
