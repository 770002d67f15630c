"""Toxicity by a weighted lexicon, matched with one automaton over folded texts.

Texts are folded first: letters that look alike become one, accents go, digits and signs that
stand for letters between letters become those letters, and everything else separates words. The
lexicon holds words and word beginnings, each with the log odds of toxic against other
labelled documents. One Aho-Corasick pass finds all of them; a word counts once, with its
heaviest entry, and not at all inside an exception phrase (a pair of words that labelled
documents show beside an entry without being toxic). The weights found, alone and per word of the
text, go through a logistic curve to a score.

The fit reads about ``max_labelled`` labelled rows, picked by a hash of the id, and all of them
when there are fewer: the lexicon, the exceptions and the curve come from these, every entry that ``min_docs`` of
them support. So the sample bounds what is sent to the tasks. Scoring covers every row in one pass
without a shuffle.

Defined cases: a null or empty text has no match and gets the score of such texts; rows without a
label do not train; rows that share an id are scored each for itself; without labels of both
kinds every score is the share of toxic labels; an empty table gives no row. Other columns pass
through.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import id_and_text, staged

# Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = str.maketrans(
    "абвгдезикмнорстухьіјѕԁһӏαβγδεζηικμνοπρτυχωϲ",
    "abbrdezukmhopctyxbijsdhlabydeznikuvonptuxwc")
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_MARKS = re.compile("[̀-ͯ​-‍­﻿]+")
_STANDS_FOR = re.compile(r"(?<=[^\W\d_])[0134578@$!|]{1,3}(?=[^\W\d_])")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_ASCII = {i: (chr(i) if chr(i).isalpha() else " ") for i in range(128)}

PREFIXES = range(3, 9)
MEASURES = 6


def fold(text: str | None) -> str:
    """Folded words between single blanks or runs of them, with a blank at both ends."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        if _FOREIGN.search(text):
            text = text.translate(HOMOGLYPHS)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("ß", "ss")
    text = _STANDS_FOR.sub(lambda m: m.group().translate(SIGNS), text)
    text = text.translate(_ASCII) if text.isascii() else _NO_LETTERS.sub(" ", text)
    return f" {text} "


def entries(word: str) -> Iterator[str]:
    """What a word may match: itself, and its beginnings."""
    yield f" {word} "
    for n in PREFIXES:
        if n < len(word):
            yield f" {word[:n]}"


def _word_before(text: str, start: int) -> str:
    end = start - 1
    while end > 0 and text[end - 1] == " ":
        end -= 1
    return text[text.rfind(" ", 0, end) + 1:end] if end > 0 else ""


def _word_after(text: str, stop: int) -> str:
    start = stop
    while start < len(text) and text[start] == " ":
        start += 1
    return text[start:text.index(" ", start)] if start < len(text) else ""


@dataclass
class ToxicModel:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...] = (0.0,)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def hits(self, text: str) -> list[tuple[str, str, str, float]]:
        """(word before, word, word after, weight) of each matched word of a folded text."""
        if not self.weights:
            return []
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            self._automaton.make_automaton()
        best: dict[int, float] = {}
        for end, (size, weight) in self._automaton.iter(text):
            start = end - size + 2  # behind the blank
            if weight > best.get(start, 0.0):
                best[start] = weight
        out = []
        for start, weight in best.items():
            stop = text.index(" ", start)
            out.append((_word_before(text, start), text[start:stop], _word_after(text, stop), weight))
        return out

    def measures(self, text: str | None) -> tuple[float, ...]:
        """MEASURES numbers: the two heaviest matched words, the weight of all distinct ones and
        their count (damped), and the weight found per word of the text."""
        folded = fold(text)
        found = [(x, w) for a, x, b, w in self.hits(folded)
                 if f"{a} {x}" not in self.exceptions and f"{x} {b}" not in self.exceptions]
        if not found:
            return (0.0,) * MEASURES
        distinct = sorted(dict(found).values(), reverse=True)
        total, length = sum(w for _, w in found), max(1, len(folded.split()))
        return (distinct[0], distinct[1] if len(distinct) > 1 else 0.0, math.log1p(sum(distinct)),
                math.log1p(len(distinct)), math.sqrt(total / length), math.sqrt(sum(distinct) / math.sqrt(length)))

    def score(self, text: str | None) -> float:
        x = self.curve[0] + sum(c * m for c, m in zip(self.curve[1:], self.measures(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            (toxic if label else other).update({e for w in set(fold(text).split()) for e in entries(w)})
    # what no toxic text of this part holds still counts, for the other parts
    both = list(toxic.keys() | other.keys())
    for a in range(0, len(both), 50_000):
        part = both[a:a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[e] for e in part], pa.int64()),
                                          pa.array([other[e] for e in part], pa.int64())], names=["entry", "toxic", "other"])


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, lightly damped, no weight below zero but the first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * np.r_[0, w[1:]]
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return tuple(w)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, min_docs: int = 5, min_precision: float = 0.75) -> ToxicModel:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks with 0 or 1."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of several labels the toxic one
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    n_toxic, n_other = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic or not n_other:
        share = (n_toxic + 1) / (n_toxic + n_other + 2)
        return ToxicModel({}, frozenset(), (math.log(share / (1 - share)),))
    # each label is thinned to about half of the bound, by a hash of the id, before any text is read
    half = max_labelled // 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    chosen = labels.where(place < F.when(F.col("toxic"), half / n_toxic).otherwise(half / n_other))
    rows = staged(id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    n_toxic, n_other = min(n_toxic, half), min(n_other, half)
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("other") + 0.5) / (n_other + 1)))
    lexicon = (rows.mapInArrow(_count_entries, "entry string, toxic long, other long")
               .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
               .where((F.col("toxic") >= min_docs)
                      & (F.col("toxic") / n_toxic >= min_precision * (F.col("toxic") / n_toxic + F.col("other") / n_other)))
               .withColumn("weight", odds).where("weight > 0").collect())
    model = ToxicModel({r.entry: r.weight for r in lexicon}, frozenset())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Counter()
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = {p for a, x, b, _ in model.hits(fold(text)) for p in (f"{a} {x}", f"{x} {b}")}
                out.update((p, label) for p in found)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([x for _, x in out], pa.bool_()),
                                              pa.array(list(out.values()), pa.int64())], names=["pair", "toxic", "n"])

    exceptions = (rows.mapInArrow(pairs, "pair string, toxic boolean, n long")
                  .groupBy("pair").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
                                       F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("other"))
                  .where(f"toxic = 0 AND other >= {min_docs}").collect())
    model = ToxicModel(model.weights, frozenset(r.pair for r in exceptions))

    columns = [f"m{k}" for k in range(MEASURES)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [model.measures(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in m], pa.float64()) for k in range(MEASURES)], batch["toxic"]],
                                             names=[*columns, "toxic"])

    points = rows.mapInArrow(measured, ", ".join(f"{c} double" for c in columns) + ", toxic boolean").toPandas()  # at most max_labelled rows
    return ToxicModel(model.weights, model.exceptions,
                      _curve(points[columns].to_numpy(), points["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[*names, "score", "predicted"])

    return docs.mapInArrow(scored, f"{fields}, score double, predicted int")
