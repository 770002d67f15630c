"""Benchmark passages in documents, by SimHash of item-sized windows.

Words are lower-cased and stripped of signs at both ends; a text's shingles are its runs of five
words (of all its words, when it has fewer). A shingle weighs more the fewer items hold it. For
each item, windows of the item's own size slide over a document. The SimHash of a window is
looked up in a multi-index: fingerprints are cut into ``radius + 1`` blocks, and two that differ
in at most ``radius`` bits agree in one of them, so the index gives every item within the radius.
What it gives is checked: first the bits, then the exact weighted similarity, the weight of
common shingles over the weight of all, counted with their repeats.

A window that shares no shingle with any item has similarity 0, so only windows over a shared
shingle, and only sizes of items that share one with the document, are fingerprinted; this loses
nothing. At the default similarity of 0.8 two fingerprints differ in 10 of 64 bits on average with
a deviation of 3; the default radius of 20 leaves out fewer than one such pair in a thousand.

Documents are read once, without a shuffle. The items are sent to the tasks in blocks of at most
``block_words`` words; a larger benchmark takes several passes. Weights are counted over all items first, and those of
shingles that several items hold go with every block, so the blocks change no similarity.

Defined cases: a null or empty text, or one without a word, matches nothing, as document or item;
a document shorter than an item is one window; rows that share an id are searched each for itself;
items with equal texts all match; ties between windows go to the first; empty tables give no match.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import held

BITS = 64
REMEMBERED = 200_000  # word hashes a worker keeps
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


class _WordHashes(dict):
    """Hash of a word without signs at its ends; 0 for what is no word."""

    def __missing__(self, word: str) -> int:
        import xxhash
        bare = word if word.isalnum() else _EDGES.sub("", word)
        value = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) or 1) if bare else 0
        self[word] = value
        return value


def word_hashes(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint64)
    known = held("bare words", _WordHashes)
    if len(known) > REMEMBERED:
        known.clear()
    found = np.array([known[w] for w in text.lower().split()], np.uint64)
    return found[found != 0]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ words[k:k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def simhash(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints of the runs of ``count`` shingles at ``starts``."""
    bits = (shingles[:, None] >> np.arange(BITS, dtype=np.uint64)) & _ONE
    signed = np.where(bits == 1, weights[:, None], -weights[:, None])
    sums = np.vstack([np.zeros(BITS), np.cumsum(signed, axis=0)])
    above = sums[starts + count] - sums[starts] > 1e-9
    return (above.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class HammingIndex:
    """Fingerprints by block; ``within`` returns all of them up to the radius."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.tables: list[dict[int, list[int]]] = []
        for shift, mask in self.blocks:
            table: dict[int, list[int]] = defaultdict(list)
            for i, value in enumerate((prints >> shift & mask).tolist()):
                table[value].append(i)
            self.tables.append(dict(table))

    def within(self, value: np.uint64) -> list[int]:
        found: set[int] = set()
        for (shift, mask), table in zip(self.blocks, self.tables, strict=True):
            found.update(table.get(int(value >> shift & mask), ()))
        return sorted(i for i in found if int(self.prints[i] ^ value).bit_count() <= self.radius)


class Spread:
    """Weights of shingles, by the number of items of the whole benchmark that hold them. One item
    or none weighs the same, so only shingles of two items or more are listed."""

    def __init__(self, items: int, repeated: np.ndarray, holders: np.ndarray) -> None:
        order = np.argsort(repeated)
        self.repeated = repeated[order]
        self.other = 1 + np.log(max(items, 1))
        self.weights = 1 + np.log(max(items, 1) / np.maximum(holders[order], 1))

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.repeated):
            return np.full(len(shingles), self.other)
        at = np.minimum(np.searchsorted(self.repeated, shingles), len(self.repeated) - 1)
        return np.where(self.repeated[at] == shingles, self.weights[at], self.other)


class Benchmark:
    """Items with weights, fingerprints by size, and their shingles in one sorted table."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int, radius: int, threshold: float, spread: Spread) -> None:
        self.shingle, self.threshold, self.spread = shingle, threshold, spread
        texts = [(key, word_hashes(text)) for key, text in items]
        texts = sorted(((k, w) for k, w in texts if len(w)), key=lambda x: (x[0] is None, x[0] or 0))
        self.keys = [k for k, _ in texts]
        runs = [shingle_hashes(w, min(shingle, len(w))) for _, w in texts]
        self.table = np.unique(np.concatenate(runs)) if runs else np.empty(0, np.uint64)
        self.counts = [Counter(r.tolist()) for r in runs]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.table >> np.uint64(42)).astype(np.int64)] = True
        self.holders: dict[int, list[int]] = defaultdict(list)
        for i, r in enumerate(runs):
            for h in set(r.tolist()):
                self.holders[h].append(i)
        self.sizes = [len(w) for _, w in texts]
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(self.sizes):
            by_size[n].append(i)
        self.by_size = {n: (members, HammingIndex(np.array([
            simhash(runs[i], self.spread.weight(runs[i]), np.array([0]), len(runs[i]))[0] for i in members], np.uint64), radius))
            for n, members in by_size.items()}
        self.lengths = sorted({min(shingle, n) for n in self.sizes})

    def __getstate__(self) -> dict:
        return {k: dict(v) if isinstance(v, defaultdict) else v for k, v in self.__dict__.items()}

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that an item holds."""
        maybe = np.flatnonzero(self.filter[(shingles >> np.uint64(42)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.table, shingles[maybe]), len(self.table) - 1)
        return maybe[self.table[at] == shingles[maybe]]

    def similarity(self, item: int, window: np.ndarray) -> float:
        mine, theirs = self.counts[item], Counter(window.tolist())
        names = np.array(sorted(mine.keys() | theirs.keys()), np.uint64)
        weights = self.spread.weight(names)
        a = np.array([mine[x] for x in names.tolist()])
        b = np.array([theirs[x] for x in names.tolist()])
        return float((weights * np.minimum(a, b)).sum() / (weights * np.maximum(a, b)).sum())

    def search(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item in a text."""
        words = word_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        for length in self.lengths:
            shingles = shingle_hashes(words, length)
            if not len(shingles):
                continue
            places = self.hits(shingles)
            if not len(places):
                continue
            sizes = {self.sizes[i] for h in set(shingles[places].tolist()) for i in self.holders[h]}
            weights = None
            for size in sorted(s for s in sizes if min(self.shingle, s) == length):
                size_here = min(size, len(words))
                count = size_here - length + 1
                starts = np.unique(np.clip((places[:, None] - np.arange(count)).ravel(), 0, len(words) - size_here))
                members, index = self.by_size[size]
                if weights is None:
                    weights = self.spread.weight(shingles)
                # neighbouring starts are fingerprinted together, over the shingles they cover
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > count) + 1):
                    a, b = int(run[0]), int(run[-1]) + count
                    for start, value in zip(run.tolist(), simhash(shingles[a:b], weights[a:b], run - a, count), strict=True):
                        for k in index.within(value):
                            item = members[k]
                            if best.get(item, (0.0,))[0] >= 1.0:
                                continue
                            sim = self.similarity(item, shingles[start:start + count])
                            if sim >= self.threshold and sim > best.get(item, (0.0,))[0]:
                                best[item] = (sim, start, size_here)
        return [(self.keys[i], *best[i]) for i in sorted(best)]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def shingle_spread(benchmark: DataFrame, shingle: int) -> Spread:
    """Counted over all items, however many blocks they are sent in."""
    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [w for w in map(word_hashes, batch["text"].to_pylist()) if len(w)]
            runs = [np.unique(shingle_hashes(w, min(shingle, len(w)))) for w in texts]
            each, n = np.unique(np.concatenate(runs), return_counts=True) if runs else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[each.view(np.int64), 0]), pa.array(np.r_[n, len(texts)]),
                                              pa.array(np.r_[np.zeros(len(each), bool), True])], names=["shingle", "n", "all"])

    counts = (_items(benchmark).select("text").mapInArrow(held_by, "shingle long, n long, all boolean")
              .groupBy("shingle", "all").agg(F.sum("n").alias("n")).where("all OR n > 1").toArrow())
    whole = counts["all"].to_numpy()
    n = counts["n"].to_numpy()
    return Spread(int(n[whole].sum()), counts["shingle"].to_numpy()[~whole].astype(np.int64).view(np.uint64), n[~whole])


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of some ``block_words`` words, dealt by a hash."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-size // block_words)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [(r.item_id, r.text) for r in part]


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 20,
            block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of each item found in each document."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, similarity double, first_word long, n_words long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, spread = [], shingle_spread(benchmark, shingle)
    for items in _blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(Benchmark(items, shingle, radius, threshold, spread))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(key, *m) for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                       for m in sent.value.search(text)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64() if i == 2 else pa.int64()) for i, c in enumerate(columns)],
                                                 names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        parts.append(docs.mapInArrow(found, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 20,
                  block_words: int = 1_000_000) -> DataFrame:
    """``docs`` without those that hold an item; all columns pass through."""
    spread = shingle_spread(benchmark, shingle)
    for items in _blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(items, shingle, radius, threshold, spread))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.search(t) for t in batch["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
