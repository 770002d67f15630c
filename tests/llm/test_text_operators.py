"""Each operator against a plain version, and on odd and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwatch.llm import jaccard, lattice, language, lines, packing, quality, repeats, toxicity
from lagwatch.llm.queries import QUERIES, tokenizer
from lagwatch.llm.suffixes import deep_shallow_order
from lagwatch.llm.token_store import PerfectIndex, TokenStore
from lagwatch.llm.tokens import WordEncoder

pytest.importorskip("tokenizers")
BPE = tokenizer()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# 1 Jaccard join


def plain_components(data, rule):
    sets = []
    for _, text, _ in data:
        w = words(fold(text or ""))
        sets.append({tuple(w[i:i + rule.n]) for i in range(max(1, len(w) - rule.n + 1))} if w else set())
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(find(i), []).append(data[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return [(data[i][0], len(sets[i]), least[find(i)] if sets[i] else data[i][0]) for i in range(len(data))]


def sort_rows(found):
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85, 100), jaccard.Rule(5, 4, 5), jaccard.Rule(2, 1, 2)])
def test_jaccard_matches_all_pairs(rows, prose, rule):
    assert sort_rows(jaccard.with_components(rows(prose, extra=True), rule).collect()) == sort_rows(plain_components(prose, rule))


def test_jaccard_odd_and_empty(rows, odd, empty):
    data = [r for r in odd if len(r[1] or "") < 10_000] + [(20, "x y z q " * 3, None), (21, "x y z q " * 3, None)]
    rule = jaccard.Rule()
    assert sort_rows(jaccard.with_components(rows(data, extra=True), rule).collect()) == sort_rows(plain_components(data, rule))
    assert jaccard.with_components(empty).collect() == []


def test_jaccard_hot_groups_in_blocks_and_salts(rows, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    data = []
    for k in range(90):  # copies of a base that is not there, each with its own edits
        copy = list(base)
        for e in range(1 + k % 4):
            copy[(k * 7 + e * 31) % 120] = f"edit{k}x{e}"
        data.append((k, " ".join(copy), None))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 20)
    for rule in (jaccard.Rule(4, 85, 100), jaccard.Rule(4, 92, 100)):
        assert sort_rows(jaccard.with_components(rows(data), rule).collect()) == sort_rows(plain_components(data, rule))


def test_jaccard_copies_and_near_copies_on_different_salts(rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    data = []
    for g in range(8):  # the copies make the n-grams frequent, but only two sets hold them
        base = [f"g{g}w{i}" for i in range(120)]
        data += [(100 * g + k, " ".join(base), None) for k in range(60)]
        data.append((100 * g + 60, " ".join([*base[:50], f"edit{g}", *base[51:]]), None))
    assert sort_rows(jaccard.with_components(rows(data)).collect()) == sort_rows(plain_components(data, jaccard.Rule()))


def test_jaccard_near_copies_without_an_id(rows):
    base = [[f"g{g}w{i}" for i in range(120)] for g in range(2)]
    near = [" ".join([*b[:50], "edit", *b[51:]]) for b in base]
    data = [(7, " ".join(base[0]), None), *[(None, near[0], None)] * 3, *[(None, " ".join(base[1]), None)] * 4, (None, near[1], None),
            *[(9, f"other text {i} under one id", None) for i in range(20)], (9, " ".join([*base[0][:80], "edit", *base[0][81:]]), None)]
    found = jaccard.grouped(rows(data)).where("size > 100").collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0)] * 5 + [(0, 7)] * 3 + [(7, 7), (9, 7)]
    assert len({r.group for r in found}) == 2


@pytest.mark.parametrize("sent", [-1, 1_000_000])
def test_jaccard_classes_in_many_pairs(rows, prose, monkeypatch, sent):
    base = [f"w{i}" for i in range(100)]
    near = [(1000 + k, " ".join([*base[:k], f"edit{k}", *base[k + 1:]]), None) for k in range(40)]
    data = [*prose, (999, " ".join(base), None), *near, (2000, near[7][1], None)]
    monkeypatch.setattr(jaccard, "GROUP_PAIRS", 3)
    monkeypatch.setattr(jaccard, "SENT_ROWS", sent)
    rule = jaccard.Rule()
    assert sort_rows(jaccard.with_components(rows(data), rule).collect()) == sort_rows(plain_components(data, rule))


def test_jaccard_joined_uses(rows, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_ROWS", -1)
    rule = jaccard.Rule()
    assert sort_rows(jaccard.with_components(rows(prose), rule).collect()) == sort_rows(plain_components(prose, rule))


# 2 quality rules


def plain_quality(text):
    w, text = words(text), text or ""
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    with_word = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(with_word) - len(set(with_word)), len(covered), failed


def test_quality_counts(rows, prose, odd):
    data = [*prose, *odd, (50, "a b c d e f g h i j k " * 3, None), (51, "x. y\nx. y\nx. y\n#|# <>", None)]
    found = quality.clean_lines(rows(data, extra=True).withColumn("plain", F.col("text")), with_text=False)
    for r in found.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(r.plain)
        assert not (r.kept and r.base_failed)


def test_quality_lines(rows, empty):
    clean = "The first sentence of a clean text stands here.\nAnother sentence follows it, with some words."
    menu = "Home | News | Sports | Contact | About\nSign in to read more\nWe use cookies on this site."
    data = [(1, clean, None), (2, f"{clean}\n{menu}", None), (3, f"{menu}\n{menu} x", None), (4, clean.replace(".", ""), None),
            (5, clean.replace(" ", "*** "), None)]
    found = {r.doc_id: r for r in quality.clean_lines(rows(data, extra=True)).collect()}
    assert found[1].kept and found[1].text == clean
    assert found[2].text == clean
    assert not found[3].kept and found[3].text == ""
    assert not found[4].kept and not found[5].kept
    assert quality.clean_lines(empty).collect() == []


def test_quality_is_native(rows, prose):
    plan = quality.clean_lines(rows(prose))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1  # the fixture's own


# 3 token store


def test_encoder_equals_whole_texts(prose, odd):
    use = WordEncoder(BPE, remember=50)
    texts = [t for _, t, _ in [*prose, *odd] if t]
    texts += ["it's 12.5%, e.g. (so)!? ", "ÀÉ. Σας ΣΑΣ", "<|endoftext|> x", "a.,b ., c", "x\x1cy z."]
    for text, ids in zip(texts, use.encode_many(texts), strict=True):
        assert ids.tolist() == use.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_in_memory_are_no_more_than_stated():
    texts = [" ".join(f"w{k}x{i}" for k in range(20 + 20 * (i % 4))) + " often" for i in range(12)]
    use, whole = WordEncoder(BPE, remember=50), WordEncoder(BPE)
    for text in texts:
        assert use.encode(text).tolist() == whole.encode(text).tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(use.recent) + len(use.older) <= 50


def plain_ids(text, end):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_round_trip(rows, prose, odd):
    data = [*[(d + 100, t, x) for d, t, x in prose], *[r for r in odd if len(r[1] or "") < 10_000]]
    store = TokenStore.write(rows(data, extra=True), BPE, end_id=2, shard_bytes=4000)
    assert store.manifest.count() > 3
    found = store.read(block=7).orderBy("start").collect()
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc, text, _) in zip(found, ordered, strict=True):
        ids = plain_ids(text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), crc(ids))
        at += len(ids)
    keys = rows([(k, None, None) for k in (100, 131, 159, 8, 5_000, -3, None)])
    looked = {r.key: r.ids for r in store.lookup(keys).collect()}
    texts = {d: t for d, t, _ in data}
    assert looked == {k: plain_ids(texts[k], 2) for k in (100, 131, 159, 8)}


def test_token_store_deals_a_wide_id_over_shards(rows):
    data = [(k, f"row {k}", None) for k in range(20)] + [(5, f"text {i} " * 40, None) for i in range(80)]
    data += [(None, "the same text " * 25, None)] * 80 + [(None, None, None)] * 5
    store = TokenStore.write(rows(data), BPE, end_id=2, shard_bytes=4000)
    shards = store.manifest.collect()
    assert max(r.rows for r in shards) < 40
    assert sum(r.null_rows > 0 for r in shards) > 3 and sum(r.low is not None and r.low <= 5 <= r.high for r in shards) > 3
    found = store.read(block=7).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((d for d, _, _ in data), key=lambda d: (d is not None, d))
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((d, crc(plain_ids(t, 2))) for d, t, _ in data)
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])[:-1]]).tolist()
    looked = {r.key: crc(r.ids) for r in store.lookup(rows([(k, None, None) for k in (4, 5, 6, 99)])).collect()}
    assert looked == {k: next(r.ids_crc32 for r in found if r.doc_id == k) for k in (4, 5, 6)}


def test_token_store_empty(empty):
    assert TokenStore.write(empty, BPE, end_id=2).read().collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_index(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    index = PerfectIndex.build(keys, np.arange(len(keys)))
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.setdiff1d(np.arange(5000), keys)) == -1).all()


# 4 packing


def check_packed(found, data, capacity):
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text, _ in data:
        ids = plain_ids(text, 0)
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [
            (k, a, len(ids[a:a + capacity]), crc(ids[a:a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(rows, prose):
    data = [*prose, (900, None, None), (901, "", None), (902, "long words here " * 500, None)]
    found = packing.pack(rows(data, extra=True), BPE, capacity=256, piece_rows=40).collect()
    used = check_packed(found, data, 256)
    assert used <= 1.1 * -(-sum(r.length for r in found) // 256)


def test_packing_odd_and_empty(rows, odd, empty):
    assert packing.pack(rows(odd), BPE).select("doc_id").distinct().count() == len({d for d, _, _ in odd})
    assert packing.pack(empty, BPE).collect() == []


def test_squares_rule():
    packer = packing.SquaresPacker(10)
    assert packer.place(6) == (0, 0)       # a gap of 4
    assert packer.place(7) == (1, 0)       # fits no gap
    assert packer.place(4) == (0, 6)       # fills a bin: one square less
    assert packer.counts.tolist() == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]


# 5 toxicity


def toxic_table(n=400):
    rng = np.random.default_rng(3)
    plain = [f"w{chr(97 + a)}{chr(97 + b)}o" for a in range(20) for b in range(20)]
    data, labels = [], []
    for i in range(n):
        text = rng.choice(plain, rng.integers(5, 60)).tolist()
        bad = i % 5 == 0
        if bad:
            text.insert(int(rng.integers(len(text))), ["grumblik", "grumbling", "snarf", "Sn4rf", "gruмblik"][i // 5 % 5])
        elif i % 17 == 0:
            text.extend(["kind", "snarf"])
        data.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    return data, labels


def test_toxicity(spark, rows):
    data, labels = toxic_table()
    docs = rows(data, extra=True)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.score(docs.drop("score"), model).collect()}
    held = [x for x in labels if x[0] % 4 == 0]
    assert np.mean([found[d].predicted == x for d, x in held]) > 0.97
    assert any("kind snarf" in e for e in model.exceptions)


def test_toxicity_folding():
    assert toxicity.fold("Sn4rf, SNARF! ѕnаrf").split() == ["snarf"] * 3
    assert toxicity.fold("in 2019 a1b").split() == ["in", "aib"]
    assert toxicity.fold(None) == " "


def plain_measures(model, text):
    """Matches word by word, without the automaton."""
    words = toxicity.fold(text).split()
    found = []
    for k, word in enumerate(words):
        weights = [w for e, w in model.weights.items() if (e[1:-1] == word if e.endswith(" ") else word.startswith(e[1:]))]
        around = {f"{words[k - 1] if k else ''} {word}", f"{word} {words[k + 1] if k + 1 < len(words) else ''}"}
        if weights and not around & model.exceptions:
            found.append((word, max(weights)))
    if not found:
        return (0.0,) * toxicity.MEASURES
    distinct = sorted(dict(found).values(), reverse=True)
    return (distinct[0], distinct[1] if len(distinct) > 1 else 0.0, np.log1p(sum(distinct)), np.log1p(len(distinct)),
            np.sqrt(sum(w for _, w in found) / len(words)), np.sqrt(sum(distinct) / np.sqrt(len(words))))


def test_toxicity_lexicon_and_scores_match_plain_counts(spark, rows):
    data, labels = toxic_table()
    model = toxicity.fit(rows(data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    marked, texts = dict(labels), {d: t for d, t, _ in data}
    toxic = [set(toxicity.fold(texts[d]).split()) for d in texts if marked.get(d) == 1]
    other = [set(toxicity.fold(texts[d]).split()) for d in texts if marked.get(d) == 0]
    count = [Counter(e for ws in part for e in {e for w in ws for e in toxicity.entries(w)}) for part in (toxic, other)]
    wanted = {}
    for e, n in count[0].items():
        share, others = n / len(toxic), count[1][e] / len(other)
        weight = np.log(((n + 0.5) / (len(toxic) + 1)) / ((count[1][e] + 0.5) / (len(other) + 1)))
        if n >= 5 and share >= 0.75 * (share + others) and weight > 0:
            wanted[e] = weight
    assert model.weights.keys() == wanted.keys() and all(abs(model.weights[e] - w) < 1e-9 for e, w in wanted.items())
    long_word = "x" * 100  # neighbours are whole words, however long
    extra = [f"{long_word} {next(iter(wanted)).strip()} {long_word}", "", None]
    for text in [*texts.values(), *extra]:
        assert np.allclose(model.measures(text), plain_measures(model, text))
    word = next(e for e in wanted if e.endswith(" ")).strip()
    assert model.hits(toxicity.fold(f"{long_word} 7 {word} {long_word}"))[0][:3] == (long_word, word, long_word)


def test_toxicity_without_labels_and_odd(spark, rows, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(rows(odd), none)
    assert {r.score for r in toxicity.score(rows(odd), model).collect()} == {0.5}
    data, labels = toxic_table(100)
    model = toxicity.fit(rows(data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(rows(odd), model).collect())
    assert toxicity.score(empty, model).collect() == []


# 6 suffix-array removal


def plain_repeats(data, length):
    texts = [(t or "").encode() for _, t, _ in data]
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc, _, _), t in zip(data, texts, strict=True):
        gone = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:len(t)] > 0
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), starts, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def cut_rows(frame):
    return [(r.doc_id, r.n_bytes, sum(s["stop"] - s["start"] for s in r.spans or ()), len(r.spans or ()), hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in frame.collect()]


@pytest.mark.parametrize(("length", "gram"), [(400, 200), (60, 20), (40, 33)])
def test_repeats(rows, prose, length, gram):
    data = [*prose, (700, "ab" * 300, None), (701, "x" * 150, None), (702, "ééé日本" * 60, None), (703, "ab" * 300, None)]
    assert sort_rows(cut_rows(repeats.remove_repeats(rows(data, extra=True), length, gram))) == sort_rows(plain_repeats(data, length))


def test_repeats_hot_grams_and_shuffled_texts(rows, prose, monkeypatch):
    passage = prose[0][1] + prose[1][1] + "end of the passage " * 5
    data = [*prose, *[(300 + k, f"{k} only here {k * k} " + passage[: 150 + k] + f"{k} after", None) for k in range(60)]]
    monkeypatch.setattr(repeats, "SENT_ROWS", -1)
    monkeypatch.setattr(repeats, "SENT_GRAMS", -1)
    monkeypatch.setattr(repeats, "PIECE", 500)
    assert sort_rows(cut_rows(repeats.remove_repeats(rows(data), 100, 50, group_rows=10))) == sort_rows(plain_repeats(data, 100))


@pytest.mark.parametrize("group_rows", [2, 8, 25, 4_000])
def test_repeats_parted_groups(rows, prose, group_rows):
    passage = (prose[0][1] + " " + prose[1][1] + " the passage that many share " * 3)[:400]
    data = [(k, f"{k} own start {k * k} " + passage[k % 7 * 9: 400 - k % 5 * 31] + f" own end {k}", None) for k in range(40)]
    data += [(100 + k, f"{k % 3} start " + passage[:260] + f"{k % 2} end", None) for k in range(12)]  # some are whole copies
    data += [(None, passage + " without an id", None)] * 5
    found = repeats.remove_repeats(rows(data), 120, 60, group_rows=group_rows)
    assert sort_rows(cut_rows(found)) == sort_rows(plain_repeats(data, 120))


def test_repeats_odd_and_empty(rows, odd, empty):
    data = [r for r in odd if len(r[1] or "") < 10_000]
    assert sort_rows(cut_rows(repeats.remove_repeats(rows(data), 400, 200))) == sort_rows(plain_repeats(data, 400))
    assert repeats.remove_repeats(empty).collect() == []


def test_deep_shallow_order():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 90)).tolist()) for _ in range(500)] + [b"a" * 80, b"a" * 81, b"a" * 80, b""]
    groups = rng.integers(0, 4, len(strings))
    order = deep_shallow_order(strings, groups)
    assert [(groups[i], strings[i], i) for i in order] == sorted((g, s, i) for i, (g, s) in enumerate(zip(groups, strings, strict=True)))


# 7 line dedup


def plain_lines(data, min_docs):
    def key(line):
        return fold(line.strip(" \t\n\x0b\f\r"))
    docs = {}
    for d, t, _ in data:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(d)
    common = {k for k, ids in docs.items() if k and len(ids) >= min_docs}
    out = []
    for d, t, _ in data:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if key(x) not in common]
        out.append((d, len(all_), len(all_) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("sent_keys", [-1, lines.SENT_KEYS])
def test_lines(rows, prose, odd, empty, sent_keys):
    data = [*prose, *[r for r in odd if r[0] is not None and len(r[1] or "") < 10_000]]
    data += [(200 + k, f"own {k}\n  Shared LINE é\r\nlast {k % 2}\n", None) for k in range(6)]
    found = lines.drop_common_lines(rows(data, extra=True), 3, sent_keys=sent_keys)
    assert sort_rows((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == sort_rows(plain_lines(data, 3))
    assert lines.drop_common_lines(empty, sent_keys=sent_keys).collect() == []


# 8 language


def plain_languages(data, train, dims=1024, seed=7):
    """Letter vectors bound, bundled and compared one n-gram at a time."""
    signs = np.random.default_rng(seed).integers(0, 2, (1 << 10, dims), np.int8).astype(int) * 2 - 1

    def symbol(c):
        return 0 if not c.isalpha() else ord(c) + 1 if ord(c) < 0x250 else 0x251 + ord(c) % (1024 - 0x251)

    def vector(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        total = np.zeros(dims)
        symbols = [0, *[s for w in words for s in (*map(symbol, w), 0)]]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            total += np.roll(signs[a], 2) * np.roll(signs[b], 1) * signs[c]
        return total if words else None
    sums = {}
    for _, text, lang in train:
        v = vector(text)
        if lang is not None and v is not None:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    protos = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    mean = protos.mean(axis=0)
    mean /= np.linalg.norm(mean)
    protos = np.array([(p - (p @ mean) * mean) for p in protos])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    out = []
    for doc, text, _ in data:
        v = vector(text)
        if v is None:
            out.append((doc, "und", 0.0))
            continue
        v = v - (v @ mean) * mean
        cos = protos @ v / np.linalg.norm(v)
        out.append((doc, names[int(cos.argmax())], max(0.0, float(cos.max()))))
    return out


@pytest.mark.parametrize("block, chain", [(2000, 8), (2, 8), (1, 2)])
def test_language_matches_plain_vectors(rows, prose, monkeypatch, block, chain):
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "CHAIN", chain)
    swap = str.maketrans("aeioukl", "ouaeilk")
    data = [(d, t.translate(swap) if d % 5 == 1 else t[::-1] if d % 5 == 2 else t.replace("a", "日") if d % 5 == 3 else t, f"l{d % 5}") for d, t, _ in prose]
    data += [(1000, "123 ?!", None), (1001, None, "l1"), (1002, "É", None)]
    model = language.fit(rows(data))
    assert (model.blocks == 1) == (block == 2000)
    found = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(rows(data, extra=True), model).collect())
    wanted = sorted(plain_languages(data, data))
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert np.allclose([x[2] for x in found], [x[2] for x in wanted], atol=1e-5)


def test_language(rows, odd, empty):
    rng = np.random.default_rng(9)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["strö", "chä", "ung", "sch"], "cc": ["eau", "ois", "tré", "ç"]}
    data = [(i, " ".join("".join(rng.choice(syllables[x], 3)) for _ in range(rng.integers(3, 50))), x)
            for i in range(150) for x in [sorted(syllables)[i % 3]]]
    model = language.fit(rows([r for r in data if r[0] % 4]))
    assert model.prototypes(0).languages == ["aa", "bb", "cc"]
    found = {r.doc_id: r for r in language.identify(rows(data, extra=True), model).collect()}
    assert all(found[d].lang_pred == x for d, _, x in data if d % 4 == 0)
    strange = language.identify(rows(odd), model).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) or r.score == 0 for r in strange)
    assert all(0 <= r.score <= 1 for r in strange)
    assert language.identify(empty, model).collect() == []
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(rows(data[:3]), nothing).collect()} == {"und"}


# 10 lattice


def test_lattice_sums_all_segmentations():
    speller = lattice.speller({"": 0.1, "a": 2.0, "ab": 1.0, "abc": 0.5}, {"a": 1.0, "b": 2.0, "c": 1.5, "bc": 0.7, **{f"<0x{b:02X}>": 1e-3 for b in range(256)}}, 3.0)

    def spelled(word, first=True):
        if not first and not word:
            return np.exp(speller.stop)
        total = 0.0
        table = speller.first if first else speller.inner
        for n in range(0 if first else 1, len(word) + 1):
            if table.get(word[:n]) is not None:
                total += np.exp(table[word[:n]]) * spelled(word[n:], False)
        if not first and speller.inner.get(word[0]) is None:
            total += np.exp(speller._bytes(word[0])) * spelled(word[1:], False)
        return total
    for word in ("a", "abc", "abcbca", "cab", "aéb", "éé", ""):
        assert np.isclose(speller.log_probability(word), np.log(spelled(word)))
    first, inner = {}, {}
    speller.expect("abcbca" * 200, first, inner)
    assert np.isclose(sum(first.values()), 1.0)
    covered = sum(len(p) * x for p, x in [*first.items(), *inner.items()])
    assert np.isclose(covered, 1200)


@pytest.mark.parametrize("word", ["a" * 400 + "漢" * 100, "漢" * 100 + "a" * 400, "bc" * 300 + "漢" * 200 + "cab" * 90, "漢" * 400 + "bcbcbcbc"])
def test_lattice_expects_words_of_uneven_cost(word):
    inner = {"a": 1.0, "b": 2.0, "c": 1.5, "bc": 0.7, "bc" * 4: 0.1, **{f"<0x{b:02X}>": 1e-9 for b in range(256)}}
    speller = lattice.speller({"": 0.1, "a": 2.0, "ab": 1.0}, inner, 3.0)
    first, inner = {}, {}
    speller.expect(word, first, inner)
    assert np.isclose(sum(first.values()), 1.0)
    assert np.isclose(sum(x for p, x in inner.items() if p.startswith("<0x")), 3 * word.count("漢"))
    assert np.isclose(sum(len(p) * x for p, x in [*first.items(), *inner.items()] if not p.startswith("<0x")), len(word) - word.count("漢"))
    plain, logs = ({}, {}), ({}, {})
    speller.expect("abcbca" * 5, *plain)
    speller._expect_in_logs("abcbca" * 5, *logs)
    for x, y in zip(plain, logs, strict=True):
        assert x.keys() == y.keys() and all(np.isclose(x[p], y[p]) for p in x)


@pytest.mark.parametrize("frequent", [0, 20, 10_000])
def test_lattice_scores(rows, prose, odd, empty, frequent):
    data = [*prose, *[(d + 500 if d is not None else None, t, x) for d, t, x in odd if len(t or "") < 10_000]]
    train = [r for r in data if r[0] is None or r[0] % 7]
    model, counts = lattice.fit(rows(train), tokenizer("piece_bpe_32k.model"), frequent_words=frequent)
    plain = Counter(w for _, t, _ in train for w in [*words(fold(t or "")), None])
    total, distinct = sum(plain.values()), len(plain)
    assert (model.total, model.distinct, model.ends) == (total, distinct, len(train))
    found = lattice.score(rows(data, extra=True), model, counts).collect()
    expected = []
    for d, t, _ in data:
        w = [*words(fold(t or "")), None]
        base = sum(np.log10((plain[x] + 1) / (total + distinct + 1)) for x in w)
        ends = (len(train) + 1) / (total + 2)
        own = sum(np.log10(1 - ends) + model.spell.log_probability(x) / np.log(10) if x else np.log10(ends) for x in w)
        arcs = sum(np.log10(10 ** (model.spell.log_probability(x) / np.log(10)) * model.discount * (distinct - 1) / total
                            + max(plain[x] - model.discount, 0) / total) if x and model.spell.log_probability(x) > -600 else
                   model.with_arc(model.spelled(x.encode("utf-8", "surrogatepass")), plain[x]) if x else np.log10(len(train) / total) for x in w)
        expected.append((d, len(w), sum(plain[x] > 0 for x in w), round(base, 5), round(own, 5), round(arcs, 5)))
    assert sort_rows((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5), round(r.word_score, 5)) for r in found) == sort_rows(expected)
    assert lattice.score(empty, model, counts).collect() == []


def test_lattice_weights_follow_the_scores(rows, prose):
    pieces = lattice.vocabulary(tokenizer("piece_bpe_32k.model"))
    speller = lattice.Law(first=1.4, inner=0.6).speller(pieces)
    assert np.isclose(sum(np.exp(w) for w in speller.first.values() if w is not None), 1)
    inner = [w for p, w in speller.inner.items() if w is not None]
    assert np.isclose(sum(np.exp(w) for w in inner) + np.exp(speller.byte).sum() + np.exp(speller.stop), 1)
    for scores, weights, a in ((pieces.first, speller.first, 1.4), (pieces.inner, speller.inner, 0.6)):
        assert np.isclose(lattice.exponent_of(scores, {p: np.exp(weights[p]) for p in scores}), a)
        best, last = max(scores, key=scores.get), min(scores, key=scores.get)
        assert np.isclose(weights[best] - weights[last], a * (scores[best] - scores[last]))
    # the step makes the training words likelier, and counts each word as often as it occurs
    counts = lattice.count_words(rows(prose))
    law = lattice.train_law(counts, pieces)
    before, after = lattice.Law().speller(pieces), law.speller(pieces)
    found = [(r.word.decode(), r.n) for r in counts.collect() if r.word]
    assert sum(n * after.log_probability(w) for w, n in found) > sum(n * before.log_probability(w) for w, n in found)
    again = lattice.train_law(counts.withColumn("n", F.col("n") * 5), pieces)
    assert np.isclose(again.inner, law.inner) and np.isclose(again.first, law.first)


def test_lattice_without_training(rows, empty, prose):
    model, counts = lattice.fit(empty, tokenizer("piece_bpe_32k.model"))
    found = lattice.score(rows(prose[:5]), model, counts).collect()
    assert len(found) == 5 and all(r.score < 0 and r.n_known == 0 for r in found)


def test_lattice_query_scores_known_words_like_the_corpus(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    data = [(i, f"quarterly shipment report number {'alpha beta gamma delta'.split()[i % 4]} arrived") for i in range(200)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op10_lattice_scores"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found if r.held_out) == held
    assert all(np.isfinite(r.score) and 1.1 * r.base_score < r.score < 0 for r in found)
    assert all(r.piece_score < r.score for r in found)
