"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is bound from its letters'
vectors, each permuted by its distance from the end, and a text is the bundle (sum) of its
n-gram vectors. The bundle of a language's labelled texts is its prototype; a document takes
the language whose prototype its own vector is closest to by cosine.

Training reads every labelled text: each task bundles its rows per language, and the numbers are
summed per (language, dimension) and stored. Up to ``BLOCK`` languages are sent to the tasks at once; a
column with more values is compared in blocks of that many, one after the other, with the same result. Prototypes are compared after their common mean is taken off, so that what all
languages share does not count; so is the document's vector by its share.

Defined cases: a null text, or one without a letter, gets ``und`` and score 0; ties go to the
language that sorts first, and so does a text whose vector vanishes, with score 0; with no labelled text every document is ``und``; rows that share an
id are judged each for itself; an empty table gives no row. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import held, staged

UNDETERMINED = "und"
GRAM = 3
SYMBOL_BITS = 10
PLAIN = 0x250  # letters below keep a symbol of their own, the others share the rest by remainder
#: Languages whose prototypes are sent at once (8 KB each), and blocks compared before the rows are stored.
BLOCK, CHAIN = 2000, 8


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    symbols = np.where(points < PLAIN, points + 1, PLAIN + 1 + points % ((1 << SYMBOL_BITS) - PLAIN - 1))
    return np.where(letter, symbols, 0).astype(np.uint32)


class GramMemory:
    """Bound vectors of letter n-grams, made when first met. ``remember`` bounds the rows kept."""

    _table: np.ndarray | None = None

    def __init__(self, dims: int, seed: int, remember: int = 32_768) -> None:
        if GramMemory._table is None:
            GramMemory._table = symbol_table()
        signs = np.random.default_rng(seed).integers(0, 2, (1 << SYMBOL_BITS, dims), np.int8) * 2 - 1
        # one copy of the letters for each place in the n-gram
        self.letters = [np.roll(signs.astype(np.int8), GRAM - 1 - place, axis=1) for place in range(GRAM)]
        self.dims, self.remember = dims, remember
        self.clear()

    def clear(self) -> None:
        self.codes, self.places = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.vectors, self.used = np.empty((1024, self.dims), np.int8), 0

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of the letters of a text, a blank between words, and their counts."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = GramMemory._table[points]
        if not symbols.any():
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        symbols = np.concatenate([[0], symbols, [0]]).astype(np.uint32)
        symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
        codes = symbols[:-2] << np.uint32(2 * SYMBOL_BITS) | symbols[1:-1] << np.uint32(SYMBOL_BITS) | symbols[2:]
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.diff(np.append(first, len(codes)))

    def _learn(self, new: np.ndarray) -> None:
        mask = np.uint32((1 << SYMBOL_BITS) - 1)
        made = self.letters[0][new >> np.uint32(2 * SYMBOL_BITS)] * self.letters[1][new >> np.uint32(SYMBOL_BITS) & mask]
        made *= self.letters[2][new & mask]
        if self.used + len(new) > len(self.vectors):
            grown = np.empty((max(2 * len(self.vectors), self.used + len(new)), self.dims), np.int8)
            grown[:self.used] = self.vectors[:self.used]
            self.vectors = grown
        self.vectors[self.used:self.used + len(new)] = made
        codes = np.concatenate([self.codes, new])
        places = np.concatenate([self.places, np.arange(self.used, self.used + len(new))])
        order = codes.argsort(kind="stable")
        self.codes, self.places, self.used = codes[order], places[order], self.used + len(new)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-gram vectors, each as often as it occurs."""
        total = np.zeros(self.dims, np.float64)
        for a in range(0, len(codes), 8192):
            part, n = codes[a:a + 8192], counts[a:a + 8192]
            if self.used > self.remember:
                self.clear()
            at = np.searchsorted(self.codes, part)
            known = at < len(self.codes)
            known[known] = self.codes[at[known]] == part[known]
            if not known.all():
                self._learn(part[~known])
                at = np.searchsorted(self.codes, part)
            total += n.astype(np.float32) @ self.vectors[self.places[at]].astype(np.float32)
        return total


def memory(dims: int, seed: int) -> GramMemory:
    """One memory per worker process."""
    return held(("grams", dims, seed), lambda: GramMemory(dims, seed))


@dataclass(frozen=True)
class Prototypes:
    """Languages in order, and their prototypes."""

    languages: list[str]
    vectors: np.ndarray  # unit rows, the mean taken off
    mean: np.ndarray     # unit vector of what all languages share
    dims: int
    seed: int

    def closest(self, text: str | None) -> tuple[str, float] | None:
        """The language closest by cosine, and the cosine; None without a letter or a language."""
        if not text or not self.languages:
            return None
        mem = memory(self.dims, self.seed)
        codes, counts = mem.grams(text)
        if not len(codes):
            return None
        vector = mem.bundle(codes, counts)
        vector -= (vector @ self.mean) * self.mean
        size = np.sqrt(vector @ vector)
        cosines = self.vectors @ vector / size if size else np.zeros(len(self.languages))
        best = int(cosines.argmax())
        return self.languages[best], float(cosines[best])


@dataclass(frozen=True)
class LanguageModel:
    """The learnt sums of all languages as a stored table (lang, block, vector), the number of blocks they
    are compared in, and what they share."""

    table: DataFrame
    blocks: int
    mean: np.ndarray
    dims: int
    seed: int

    def prototypes(self, block: int) -> Prototypes:
        rows = sorted(self.table.where(F.col("block") == block).collect(), key=lambda r: r.lang)
        vectors = _units(np.array([r.vector for r in rows]).reshape(-1, self.dims))
        vectors = _units(vectors - (vectors @ self.mean)[:, None] * self.mean)
        return Prototypes([r.lang for r in rows], vectors, self.mean, self.dims, self.seed)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit(labelled: DataFrame, dims: int = 1024, seed: int = 7) -> LanguageModel:
    """Prototypes of all rows of (text, lang) with a language and a letter."""
    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem, sums = memory(dims, seed), {}

        def added() -> Iterator[pa.RecordBatch]:
            for lang, vector in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.float64()))],
                                                 names=["lang", "vector"])
            sums.clear()

        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                codes, counts = mem.grams(text)
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts))
            for lang, parts in held.items():
                codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n for _, n in parts]))
                sums[lang] = sums.get(lang, 0) + mem.bundle(codes, counts)
            if len(sums) > BLOCK:
                yield from added()
        yield from added()

    rows = (labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .where("text IS NOT NULL AND lang IS NOT NULL")
            .mapInArrow(bundles, "lang string, vector array<double>")
            .select("lang", F.posexplode("vector").alias("dim", "value"))
            .groupBy("lang", "dim").agg(F.sum("value").alias("value")))
    sums = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value")))["value"].alias("vector"))
    table = staged(sums, "languages")
    languages = table.count()
    blocks = -(-languages // BLOCK) if languages <= BLOCK else 1 + languages * 5 // (4 * BLOCK)  # dealt by a hash, so with some room
    table = table.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(max(blocks, 1))).cast("int"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims)
        for batch in batches:
            total += _units(batch["vector"].flatten().to_numpy().reshape(-1, dims)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], names=["dim", "value"])

    mean = np.zeros(dims)
    if languages > 1:  # one language shares nothing with others
        for r in table.select("vector").mapInArrow(shared, "dim int, value double").groupBy("dim").agg(F.sum("value").alias("value")).collect():
            mean[r.dim] = r.value
        mean /= np.maximum(np.linalg.norm(mean), 1e-300)
    return LanguageModel(table, blocks, mean, dims, seed)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the cosine, negative ones as 0."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*names, F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score"))
    for block in range(model.blocks):
        if block and block % CHAIN == 0:
            out = staged(out, "languages-so-far")
        out = _compared(out, names, model.prototypes(block))
    return out.select(*names, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("score"))


def _compared(docs: DataFrame, names: list[str], prototypes: Prototypes) -> DataFrame:
    """Documents with the better of what they have and what is closest among these prototypes."""
    sent = docs.sparkSession.sparkContext.broadcast(prototypes)  # at most some BLOCK languages x dimensions

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, lang, score in zip(batch["text"].to_pylist(), batch["lang_pred"].to_pylist(), batch["score"].to_pylist(), strict=True):
                best = sent.value.closest(text)
                before = (lang, score)
                found.append(before if best is None else best if lang is None else min(before, best, key=lambda x: (-x[1], x[0])))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(judged, docs.schema)


def held_out(doc_id, every: int, remainder: int):
    """Whether the checksum of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == remainder, F.lit(False))
