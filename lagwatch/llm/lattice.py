"""Log probability of texts by a subword lattice.

The pieces and their scores come from an existing vocabulary. A word is spelled by a first piece and
inner pieces up to a stop, in every segmentation the vocabulary allows; the forward recursion, in
log space, sums over all of them. Scores that are whole numbers are merge ranks, and rank r weighs
(r + RANK_OFFSET) ** -a; other scores are log probabilities s, and weigh exp(a s). So the scores alone
say how pieces compare. The corpus sets what the file does not hold, by an expectation step over
all training words, each as often as it occurs: the exponent a of first and of inner pieces, and how
often a word begins without a first piece, ends, or takes bytes. A byte-fallback piece
stands for each byte of a character without a piece, so every text has a probability.

``score`` is the marginal log10 probability of the text: a word has (1 - e) times the sum over its
segmentations, the end token e, the share of ends among the training tokens with one of each kind
added. ``word_score`` is a second column, in which training words also are single arcs: a word seen c
times has (c - d) / N, with the discount d taken from the numbers of words seen once and twice, and
what the discounts free goes to the spelled words.

Counts cover all training texts. Only the words above a count that at most ``frequent_words``
words reach are sent to the tasks; each other occurrence is a row (word, document) that is joined
with the counts by a shuffle and spelled once per word there.

Defined cases: a null or empty text has only the end token; rows that share an id and text get
the same result; a null id is not held out; without training texts every word is spelled with the
weights before the step; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import id_and_text, staged

END = b""  # no word is empty, so the end token has this key
START = "▁"
_FLUSH = 1_000_000
_LN10 = math.log(10)
RANK_OFFSET = 100.0


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z folded, as bytes, without the end token."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Speller:
    """Log weights of first and inner pieces; inner weights include the stop.

    Both tables also hold every beginning of a piece, with None where it is no piece itself, so a
    search for the pieces at a place of a word ends at the first string that begins none.
    """

    def __init__(self, first: dict[str, float], inner: dict[str, float], stop: float) -> None:
        self.first, self.inner, self.stop = _with_beginnings(first), _with_beginnings(inner), stop
        self.byte = [inner[f"<0x{b:02X}>"] for b in range(256)]

    def _bytes(self, letter: str) -> float:
        return sum(self.byte[b] for b in letter.encode("utf-8", "surrogatepass"))

    def log_probability(self, word: str) -> float:
        """Marginal over all segmentations, by the forward recursion in log space."""
        n, none = len(word), -math.inf
        alpha = [none] * (n + 1)
        exp, log1p, first, inner = math.exp, math.log1p, self.first, self.inner
        for j in range(n + 1):
            w = first.get(word[:j], 0)
            if w == 0:
                break
            if w is not None:
                alpha[j] = w
        for i in range(n):
            a = alpha[i]
            if a == none:
                continue
            single = False
            for j in range(i + 1, n + 1):
                w = inner.get(word[i:j], 0)
                if w == 0:
                    break
                if w is not None:
                    single = single or j == i + 1
                    x, y = a + w, alpha[j]
                    alpha[j] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
            if not single:
                x, y = a + self._bytes(word[i]), alpha[i + 1]
                alpha[i + 1] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return alpha[n] + self.stop

    def expect(self, word: str, firsts: dict[str, float], inners: dict[str, float], times: int = 1) -> None:
        """Add the expected uses of each piece in so many occurrences of the word, by the forward and the
        backward recursion. Weights are lifted per letter, so that plain numbers reach; where they
        do not, for long words, by the word's own probability; and where that does not reach at every
        letter, for words with stretches of different cost, the recursions go in log space."""
        try:
            done = (self._expect(word, firsts, inners, 1.7, times)
                    or self._expect(word, firsts, inners, -self.log_probability(word) / (len(word) + 1), times))
        except OverflowError:  # before anything was added
            done = False
        if not done:
            self._expect_in_logs(word, firsts, inners, times)

    def _expect(self, word: str, firsts: dict[str, float], inners: dict[str, float], lift: float, times: int) -> bool:
        """Whether plain numbers reached; if not, nothing is added."""
        n, exp = len(word), math.exp
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        starts, arcs = [], []
        for j in range(n + 1):
            w = self.first.get(word[:j], 0)
            if w == 0:
                break
            if w is not None:
                x = exp(w + lift * j)
                alpha[j] = x
                starts.append((j, word[:j], x))
        inner = self.inner
        for i in range(n):
            a = alpha[i]
            if not 1e-250 < a < 1e250:
                # no segmentation ends here, or its number is out of range
                if a or any(j == i for j, _, _ in starts) or any(j == i for _, j, _, _ in arcs):
                    return False
                continue
            single = False
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                w = inner.get(piece, 0)
                if w == 0:
                    break
                if w is not None:
                    single = single or j == i + 1
                    x = exp(w + lift * (j - i))
                    alpha[j] += a * x
                    arcs.append((i, j, piece, x))
            if not single:
                x = exp(self._bytes(word[i]) + lift)
                alpha[i + 1] += a * x
                arcs.append((i, i + 1, None, x))
        whole = alpha[n]
        if not 1e-200 < whole < 1e200:
            return False
        beta[n] = times / whole
        for i, j, piece, x in reversed(arcs):
            y = x * beta[j]
            if y:
                beta[i] += y
                y *= alpha[i]
                if piece is not None:
                    inners[piece] = inners.get(piece, 0.0) + y
                else:
                    for b in word[i].encode("utf-8", "surrogatepass"):
                        name = f"<0x{b:02X}>"
                        inners[name] = inners.get(name, 0.0) + y
        for j, piece, x in starts:
            y = x * beta[j]
            if y:
                firsts[piece] = firsts.get(piece, 0.0) + y
        return True

    def _expect_in_logs(self, word: str, firsts: dict[str, float], inners: dict[str, float], times: int = 1) -> None:
        n, none, exp, inner = len(word), -math.inf, math.exp, self.inner
        alpha, beta = [none] * (n + 1), [none] * (n + 1)
        starts, arcs = [], []
        for j in range(n + 1):
            w = self.first.get(word[:j], 0)
            if w == 0:
                break
            if w is not None:
                alpha[j] = w
                starts.append((j, word[:j], w))
        for i in range(n):
            a = alpha[i]
            if a == none:
                continue
            single = False
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                w = inner.get(piece, 0)
                if w == 0:
                    break
                if w is not None:
                    single = single or j == i + 1
                    alpha[j] = _log_sum(alpha[j], a + w)
                    arcs.append((i, j, piece, w))
            if not single:
                w = self._bytes(word[i])
                alpha[i + 1] = _log_sum(alpha[i + 1], a + w)
                arcs.append((i, i + 1, None, w))
        beta[n] = math.log(times) - alpha[n]
        for i, j, piece, w in reversed(arcs):
            y = w + beta[j]
            if y == none:
                continue
            beta[i] = _log_sum(beta[i], y)
            y = exp(alpha[i] + y)
            if piece is not None:
                inners[piece] = inners.get(piece, 0.0) + y
            else:
                for b in word[i].encode("utf-8", "surrogatepass"):
                    name = f"<0x{b:02X}>"
                    inners[name] = inners.get(name, 0.0) + y
        for j, piece, w in starts:
            firsts[piece] = firsts.get(piece, 0.0) + exp(w + beta[j])


def _log_sum(x: float, y: float) -> float:
    """Logarithm of the sum of two numbers, the second of them above 0."""
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def _with_beginnings(weights: dict[str, float]) -> dict[str, float | None]:
    # an inner byte piece is found by its byte, not by its name
    out: dict[str, float | None] = {p: w for p, w in weights.items() if not p.startswith("<0x")}
    for piece in list(out):
        for n in range(1, len(piece)):
            out.setdefault(piece[:n], None)
    return out


def speller(first: dict[str, float], inner: dict[str, float], stops: float) -> Speller:
    """Weights from counts, each distribution normalised."""
    total_first, total_inner = sum(first.values()), sum(inner.values()) + stops
    return Speller({p: math.log(c / total_first) for p, c in first.items()},
                   {p: math.log(c / total_inner) for p, c in inner.items()}, math.log(stops / total_inner))


@dataclass(frozen=True)
class Vocabulary:
    """First and inner pieces of a vocabulary file with the number their weight is a power of."""

    first: dict[str, float]
    inner: dict[str, float]


def vocabulary(model_file: str) -> Vocabulary:
    """Pieces that hold a capital, a control or a second start mark spell no word. The bare start
    mark and the bytes are no pieces here: how often they are used is the corpus's to say."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size())
              if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    merges = all(x == int(x) for x in usable.values())
    first, inner = {}, {}
    for piece, x in usable.items():
        if START in piece[1:] or piece == START or piece != piece.lower():
            continue
        into, rest = (first, piece[1:]) if piece.startswith(START) else (inner, piece)
        into[rest] = -math.log(RANK_OFFSET - x) if merges else x
    return Vocabulary(first, inner)


@dataclass(frozen=True)
class Law:
    """What the corpus sets: exponents, and the shares of words that begin without a first piece, and of
    inner steps that are a stop or a byte."""

    first: float = 1.0
    inner: float = 1.0
    bare: float = 0.1
    stop: float = 0.3
    byte: float = 0.01

    def speller(self, pieces: Vocabulary) -> Speller:
        first = {p: x + math.log(1 - self.bare) for p, x in _powers(pieces.first, self.first).items()}
        inner = {p: x + math.log(1 - self.stop - self.byte) for p, x in _powers(pieces.inner, self.inner).items()}
        return Speller(first | {"": math.log(self.bare)},
                       inner | {f"<0x{b:02X}>": math.log(self.byte / 256) for b in range(256)}, math.log(self.stop))


def _powers(scores: dict[str, float], exponent: float) -> dict[str, float]:
    """Log weights, normalised."""
    if not scores:
        return {}
    top = max(scores.values())
    whole = exponent * top + math.log(sum(math.exp(exponent * (x - top)) for x in scores.values()))
    return {p: exponent * x - whole for p, x in scores.items()}


def exponent_of(scores: dict[str, float], uses: dict[str, float]) -> float:
    """The likeliest exponent: the one at which the mean score is that of the uses. 1 without uses."""
    n = sum(uses.values())
    if not n or not scores:
        return 1.0
    x, k = np.array(list(scores.values())), np.array([uses.get(p, 0.0) for p in scores])
    wanted, low, high = float((x * k).sum() / n), 0.0, 16.0
    for _ in range(60):
        a = (low + high) / 2
        weights = np.exp(a * (x - x.max()))
        low, high = (a, high) if (x * weights).sum() / weights.sum() < wanted else (low, a)
    return (low + high) / 2


def _decode(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end token under the empty word."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: Counter) -> Iterator[pa.RecordBatch]:
            words = list(found)
            for a in range(0, len(words), 100_000):
                part = words[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([found[w] for w in part], pa.int64())],
                                                 names=["word", "n"])
            found.clear()

        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found.update(tokens(text))
                if len(found) >= _FLUSH:
                    yield from flush(found)
            found[END] += batch.num_rows
        yield from flush(found)

    return (docs.select("text").mapInArrow(counts, "word binary, n long").where("n > 0")
            .groupBy("word").agg(F.sum("n").alias("n")))


def train_law(words: DataFrame, pieces: Vocabulary) -> Law:
    """One expectation step over all training words; sums come back per piece of the vocabulary."""
    sent = words.sparkSession.sparkContext.broadcast(Law().speller(pieces))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, firsts, inners, stops = sent.value, {}, {}, 0.0
        for batch in batches:
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if word != END:
                    use.expect(_decode(word), firsts, inners, n)
                    stops += n
        rows = [(True, p, x) for p, x in firsts.items()] + [(False, p, x) for p, x in inners.items()] + [(None, "", stops)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.float64())], names=["first", "piece", "x"])

    sums = words.mapInArrow(expected, "first boolean, piece string, x double").groupBy("first", "piece").agg(F.sum("x").alias("x")).collect()
    stops = sum(r.x for r in sums if r["first"] is None)
    if not stops:
        return Law()
    first = {r.piece: r.x for r in sums if r["first"]}
    inner = {r.piece: r.x for r in sums if r["first"] is False}
    taken = sum(x for p, x in inner.items() if p.startswith("<0x"))
    steps = sum(inner.values()) + stops
    bare = first.pop("", 0.0)
    # one use more of each kind, so that none is impossible
    return Law(exponent_of(pieces.first, first), exponent_of(pieces.inner, {p: x for p, x in inner.items() if not p.startswith("<0x")}),
               (bare + 1) / (stops + 2), (stops + 1) / (steps + 3), (taken + 1) / (steps + 3))


@dataclass
class TextModel:
    """Totals of the training tokens, the speller, and the scores of frequent words."""

    total: int
    distinct: int
    ends: int
    discount: float
    spell: Speller
    frequent: dict[bytes, tuple[float, float, float]]  # log10 probability: base, spelled, with arcs

    def base(self, count: int) -> float:
        return math.log10((count + 1) / (self.total + self.distinct + 1))

    def end(self) -> float:
        return math.log10((self.ends + 1) / (self.total + 2))

    def spelled(self, word: bytes) -> float:
        """log10 probability of one word over all its segmentations, after the choice of no end."""
        return self.spell.log_probability(_decode(word)) / _LN10 + math.log10((self.total - self.ends + 1) / (self.total + 2))

    def arc_end(self) -> float:
        return math.log10(self.ends / self.total) if self.ends else 0.0

    def with_arc(self, spelled: float, count: int) -> float:
        """The same with the word itself as an arc, if it was seen."""
        if not self.total:
            return spelled
        spelled += math.log10(self.discount * max(self.distinct - 1, 1) / self.total) - math.log10((self.total - self.ends + 1) / (self.total + 2))
        if count <= self.discount:
            return spelled
        arc = math.log10((count - self.discount) / self.total)
        low, high = sorted((arc, spelled))
        return high + math.log10(1 + 10 ** (low - high))

    def word(self, word: bytes, count: int) -> tuple[float, float, float]:
        spelled = self.spelled(word)
        return self.base(count), spelled, self.with_arc(spelled, count)


def fit(train: DataFrame, model_file: str, frequent_words: int = 300_000) -> tuple[TextModel, DataFrame]:
    """The model, and the table of all counts."""
    words = staged(count_words(id_and_text(train)), "word-counts")
    is_word = F.col("word") != F.lit(END)
    total = words.agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(~is_word, F.col("n"))).alias("ends"),
        F.count_if(is_word & (F.col("n") == 1)).alias("once"), F.count_if(is_word & (F.col("n") == 2)).alias("twice")).first()
    step = F.floor(F.log2("n") * 8).cast("int")  # some hundred steps, whatever the counts
    reached, least = 0, None
    for r in sorted(words.where(is_word).groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        reached += r["count"]
        if reached > frequent_words:
            break
        least = r.step
    discount = total.once / (total.once + 2 * total.twice) if total.once else 0.5
    pieces = vocabulary(model_file)
    model = TextModel(total.total or 0, total.distinct, total.ends or 0, min(0.95, max(0.05, discount)),
                      train_law(words, pieces).speller(pieces), {})
    if least is None:
        return model, words

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.word(w, n) for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True)]
            columns = zip(*found, strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([batch["word"], *(pa.array(c, pa.float64()) for c in columns)], names=["word", *_SCORES])

    found = (words.where(is_word & (step >= least)).select("word", "n")
             .mapInArrow(scored, "word binary, base_score double, score double, word_score double").toArrow())
    scores = zip(*(found[c].to_pylist() for c in _SCORES), strict=True)
    return replace(model, frequent=dict(zip(found["word"].to_pylist(), scores, strict=True))), words


def score(docs: DataFrame, model: TextModel, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and word_score of each row."""
    keyed = id_and_text(docs).withColumn("__row", F.monotonically_increasing_id())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row with the sums over its frequent words (word null), and a row for
        each other word."""
        m = sent.value
        known, ends = m.frequent, (m.base(m.ends), m.end(), m.arc_end())
        for batch in batches:
            texts: list[tuple] = []
            rows: list[int] = []
            keys: list[int | None] = []
            others: list[bytes] = []
            times: list[int] = []
            for row, key, text in zip(batch["__row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n, (base, own, arcs), before = 0, ends, len(others)
                for word, k in Counter(tokens(text)).items():
                    each = known.get(word)
                    if each is None:
                        others.append(word)
                        times.append(k)
                        continue
                    n += k
                    base += k * each[0]
                    own += k * each[1]
                    arcs += k * each[2]
                texts.append((row, key, n + 1, n + (m.ends > 0), base, own, arcs))
                rows.extend([row] * (len(others) - before))
                keys.extend([key] * (len(others) - before))
                if len(others) > 50_000:
                    yield from _rows(texts, rows, keys, others, times)
                    texts, rows, keys, others, times = [], [], [], [], []
            yield from _rows(texts, rows, keys, others, times)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a word, sorted by it, as sums like the others; a word is spelled once."""
        m, last, found = sent.value, None, (0.0, 0.0, 0.0)
        for batch in batches:
            words_ = batch["word"].to_pylist()
            if not words_:
                continue
            new = [i for i in range(len(words_)) if i == 0 or words_[i] != words_[i - 1]]
            counts = batch["n"].fill_null(0).to_numpy(zero_copy_only=False)
            scores = []
            for i in new:
                if words_[i] != last:
                    last = words_[i]
                    found = m.word(last, int(counts[i]))
                scores.append(found)
            each = np.repeat(np.array(scores), np.diff([*new, len(words_)]), axis=0)
            k = batch["k"].to_numpy().astype(np.int64)
            zeros = pa.nulls(len(k), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["__row"], batch["doc_id"], zeros, batch["k"], pa.array(k), pa.array(np.where(counts > 0, k, 0)),
                 *(pa.array(k * each[:, c]) for c in range(3))], names=_PART_NAMES)

    split = staged(keyed.select("__row", "doc_id", "text").mapInArrow(parts, _PARTS), "word-parts")
    rare = (split.where("word IS NOT NULL").select("__row", "doc_id", "word", "k").join(words, "word", "left")
            .select("__row", "doc_id", "word", "k", "n").sortWithinPartitions("word").mapInArrow(spelled, _PARTS))
    return (split.where("word IS NULL").unionByName(rare).groupBy("__row")
            .agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                 *(F.sum(c).alias(c) for c in _SCORES)).drop("__row"))


_PARTS = "__row long, doc_id long, word binary, k int, n_tokens long, n_known long, base_score double, score double, word_score double"
_SCORES = ["base_score", "score", "word_score"]
_PART_NAMES = ["__row", "doc_id", "word", "k", "n_tokens", "n_known", *_SCORES]


def _rows(texts: list[tuple], rows: list[int], keys: list, words: list[bytes], times: list[int]) -> Iterator[pa.RecordBatch]:
    if texts:
        row, key, n, known, *scores = zip(*texts, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(key, pa.int64()), pa.nulls(len(row), pa.binary()), pa.array(np.zeros(len(row), np.int32)),
             pa.array(n, pa.int64()), pa.array(known, pa.int64()), *(pa.array(c, pa.float64()) for c in scores)], names=_PART_NAMES)
    if words:
        zeros, nothing = pa.array(np.zeros(len(words), np.int64)), [pa.array(np.zeros(len(words)))] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32()),
             zeros, zeros, *nothing], names=_PART_NAMES)
