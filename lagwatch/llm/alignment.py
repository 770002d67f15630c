"""Alignment of the tokens of two tokenizers.

A text is encoded by tokenizer A (byte-level BPE, with a space before the text) and by tokenizer B
(pieces; it adds that space itself). Both cut the same bytes. The places where tokens of both end are
found by divide and conquer: from the middle of an interval outwards, an end of A is looked up among
the ends of B by bisect; at the first that both have, the interval is cut, and both halves are treated
alike. An interval without such a place is a group: these A tokens stand for those B tokens. All
intervals of a level, of many texts, are searched in one go.

A group's last tokens end together and are linked; ``count_links`` says how often an id pair is linked
in the whole table, and how a text's links fare by these counts.

Defined cases: a text that is null or empty, or that one of the tokenizers does not give back byte by
byte (B spells U+2581 as a space), has no tokens, no groups and no links. Every row gives one row,
repeated and null ids too. Texts of any length are encoded whole. An empty table gives no rows. Other
columns are ignored. What is sent to tasks: the counted pairs up to ``SENT_PAIRS``, joined by
shuffle beyond it, with the same rows. The driver holds no row of a document.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import SALTS, held, id_and_text, staged

#: Pairs with their counts that are sent to the tasks at most (17 bytes each).
SENT_PAIRS = 2_000_000
#: Places tried outwards from the middles of all intervals together, before an interval is searched whole.
NEAR = 5

#: Stands for the ids of a run that a tokenizer does not give back: its text is encoded in one piece.
ODD = ()

_SPACE_MARK = "▁"  # fixed value: how B's pieces spell a space
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUN_STARTS = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level tokenizers write bytes: printable ones as themselves, the
    others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairEncoder:
    """Ids of A and of B for whole texts.

    No token of A holds a non-space followed by white space, and none of these piece vocabularies
    does. So a text is encoded run by run (white space, then what follows up to the next space or
    line end), and the ids of ``remember`` runs are kept. For vocabularies of other kinds, texts are
    encoded in one piece. Which runs are remembered changes no id.
    """

    def __init__(self, a_path: str, b_path: str, remember: int = 300_000, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size_a = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
                        for t in (self.a.id_to_token(i) or "" for i in range(size_a))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(_SPACE_MARK)
        form = json.loads(self.a.to_str())
        cuts = form["pre_tokenizer"] or {}
        self.by_runs = (cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
                        and form["normalizer"] is None and self.b.id_to_piece(self.mark) == _SPACE_MARK
                        and not any("\n" in p or re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) for p in pieces))
        self.remember, self.longest = remember, longest
        self.recent: dict[str, tuple[bytes, bytes] | tuple[()]] = {}
        self.older: dict[str, tuple[bytes, bytes] | tuple[()]] = {}

    @staticmethod
    def runs(text: str) -> list[str]:
        """The runs of a text that starts with a space; each starts with a space or a line end."""
        return _RUN_STARTS.split(text) if _OTHER_SPACE.search(text) else _RUNS.findall(text)

    def _both(self, runs: list[str]) -> Iterator[tuple[bytes, bytes] | tuple[()]]:
        """Ids of each run, as bytes; ``ODD`` where a tokenizer does not give the run back."""
        for at in range(0, len(runs), 10_000):
            some = runs[at:at + 10_000]
            # B adds a space before what it gets: that is the first one here, or it goes again before a line end
            for run, a, b in zip(some, self.a.encode_batch(some, add_special_tokens=False),
                                 self.b.encode([r[1:] if r[0] == " " else r for r in some], num_threads=1), strict=True):
                b = ([self.mark] if run == " " else b) if run[0] == " " else b[1:]
                plain = run.encode()
                a = a.ids
                if b"".join([self.a_bytes[i] for i in a]) == plain and b"".join([self.b_bytes[i] for i in b]) == plain:
                    yield np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()
                else:
                    yield ODD

    def _learn(self, missing: set[str]) -> dict[str, tuple[bytes, bytes] | tuple[()]]:
        """Ids of the missing runs; those that are not too long are remembered."""
        if len(self.recent) + len(missing) > self.remember:
            self.older, self.recent = self.recent, {}
        got = {run: self.older[run] for run in missing if run in self.older}
        new = [run for run in missing if run not in got]
        got.update(zip(new, self._both(new), strict=True))
        self.recent.update((run, ids) for run, ids in got.items() if len(run) <= self.longest)
        return got

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text encoded in one piece; none where a tokenizer does not give it back."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        plain = (" " + text).encode()
        if b"".join([self.a_bytes[i] for i in a]) != plain or b"".join([self.b_bytes[i] for i in b]) != plain:
            return b"", b""
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def encode_many(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of each text by A and by B (little-endian, 32 bits)."""
        if not self.by_runs:
            return [self.whole(t) if t else (b"", b"") for t in texts]
        runs = [self.runs(" " + t) if t else [] for t in texts]
        found = [list(map(self.recent.get, rs)) for rs in runs]
        missing = {r for f, rs in zip(found, runs, strict=True) if None in f for r, ids in zip(rs, f, strict=True) if ids is None}
        new = self._learn(missing) if missing else {}
        out = []
        for text, f, rs in zip(texts, found, runs, strict=True):
            ids = [new[r] if x is None else x for r, x in zip(rs, f, strict=True)] if None in f else f
            if ODD in ids:
                out.append(self.whole(text))
            else:
                out.append((b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids])))
        return out


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups stop: for each, the number of A tokens and of B tokens up to its end, in order.

    ``ends`` are the byte ends of the tokens, rising; ``stops`` the numbers of tokens up to the end
    of each text, where both end together.
    """
    found_a, found_b = [stops_a], [stops_b]
    a0, b0 = np.r_[0, stops_a[:-1]], np.r_[0, stops_b[:-1]]
    a1, b1 = stops_a, stops_b
    while True:
        more = (a1 - a0 > 1) & (b1 - b0 > 1)  # with one token on a side there is nothing to cut
        a0, a1, b0, b1 = a0[more], a1[more], b0[more], b1[more]
        if not len(a0):
            break
        cut_a, cut_b = _near_middles(ends_a, ends_b, a0, a1)
        has = cut_a >= 0  # an interval without a cut is a group
        a0, a1, b0, b1, cut_a, cut_b = a0[has], a1[has], b0[has], b1[has], cut_a[has] + 1, cut_b[has] + 1
        found_a.append(cut_a)
        found_b.append(cut_b)
        a0, a1 = np.stack([a0, cut_a], 1).ravel(), np.stack([cut_a, a1], 1).ravel()
        b0, b1 = np.stack([b0, cut_b], 1).ravel(), np.stack([cut_b, b1], 1).ravel()
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _near_middles(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the A token nearest to its middle, the last one aside, that ends where a B
    token ends, and that B token; -1 where there is none."""
    cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
    middle, todo = (a0 + a1 - 2) // 2, np.arange(len(a0))
    for k in range(NEAR):
        at = middle[todo] + ((k + 1) // 2 if k % 2 else -(k // 2))
        inside = (at >= a0[todo]) & (at < a1[todo] - 1)
        here, at = todo[inside], at[inside]
        place = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[place] == ends_a[at]
        cut_a[here[hit]], cut_b[here[hit]] = at[hit], place[hit]
        todo = todo[cut_a[todo] < 0]
        if not len(todo):
            return cut_a, cut_b
    todo = todo[a1[todo] - 1 - a0[todo] > NEAR]  # the shorter ones have been searched whole
    if len(todo):
        size = a1[todo] - 1 - a0[todo]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(a0[todo] - first, size)
        place = np.searchsorted(ends_b, ends_a[at])
        away = np.abs(at - np.repeat(middle[todo], size))
        away[ends_b[place] != ends_a[at]] = len(ends_a) + 1
        least = np.minimum.reduceat(away, first)
        best = np.flatnonzero(away == np.repeat(least, size))
        owner = np.searchsorted(first, best, side="right") - 1
        owner, once = np.unique(owner, return_index=True)
        ok = least[owner] <= len(ends_a)
        cut_a[todo[owner[ok]]], cut_b[todo[owner[ok]]] = at[best[once[ok]]], place[best[once[ok]]]
    return cut_a, cut_b


class Aligner:
    """Groups and links of many texts at a time."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.encoder = PairEncoder(a_path, b_path)
        self.size_a = np.array([len(t) for t in self.encoder.a_bytes])
        self.size_b = np.array([len(t) for t in self.encoder.b_bytes])
        self.spelled = np.array([f"{i}{after}" for i in range(len(self.size_a)) for after in ",|"]
                                + [f"{i}{after}" for i in range(len(self.size_b)) for after in ",;"], object)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text: tokens of A and of B, groups, the groups spelled out, the distinct linked
        pairs (A's id times 2**32 plus B's), and how often each is linked."""
        ids = self.encoder.encode_many(texts)
        full = [k for k, (a, _) in enumerate(ids) if a]
        out: list[tuple] = [(0, 0, 0, "", (), ())] * len(texts)
        if not full:
            return out
        a = np.frombuffer(b"".join([ids[k][0] for k in full]), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join([ids[k][1] for k in full]), "<u4").astype(np.int64)
        stops_a = np.cumsum([len(ids[k][0]) // 4 for k in full])
        stops_b = np.cumsum([len(ids[k][1]) // 4 for k in full])
        cut_a, cut_b = shared_cuts(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), stops_a, stops_b)
        links = a[cut_a - 1] << 32 | b[cut_b - 1]
        words = self._spell(a, b, cut_a, cut_b)
        groups = np.searchsorted(cut_a, stops_a, side="right")
        a0 = b0 = g0 = 0
        for k, a1, b1, g1 in zip(full, stops_a.tolist(), stops_b.tolist(), groups.tolist(), strict=True):
            pairs, uses = np.unique(links[g0:g1], return_counts=True)
            out[k] = a1 - a0, b1 - b0, g1 - g0, "".join(words[a0 + b0:a1 + b1])[:-1], pairs, uses
            a0, b0, g0 = a1, b1, g1
        return out

    def _spell(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """Every id with the mark that follows it, A's of a group before B's."""
        in_a, in_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        code = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        code[np.arange(len(a)) + np.repeat(cut_b - in_b, in_a)] = 2 * a + last_a
        code[np.arange(len(b)) + np.repeat(cut_a, in_b)] = 2 * (len(self.size_a) + b) + last_b
        return self.spelled[code].tolist()


def _batches(texts: Iterable[str | None], chars: int = 400_000) -> Iterator[list[str | None]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "") + 50
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


_ALIGNED = ("__row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, uses array<int>")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, ``groups`` (``a1,a2|b1;a3|b2,b3`` with the ids in
    order), ``pairs`` (the distinct linked pairs, A's id times 2**32 plus B's) and ``uses`` (how often
    the text links each). ``__row`` numbers the rows."""
    keyed = id_and_text(docs).withColumn("__row", F.monotonically_increasing_id())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = held(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            at = 0
            for some in _batches(batch["text"].to_pylist()):
                n_a, n_b, groups, spelled, pairs, uses = zip(*use.align(some), strict=True)
                offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in pairs])], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch["__row"].slice(at, len(some)), batch["doc_id"].slice(at, len(some)),
                    pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.int64()), pa.array(spelled, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs).astype(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(uses).astype(np.int32)))],
                    names=["__row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "uses"])
                at += len(some)

    return keyed.select("__row", "doc_id", "text").mapInArrow(rows, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of the pair in all rows), best (no other pair of its B id has more)."""

    def added(batches: Iterator[pa.RecordBatch], at_once: int = 2_000_000) -> Iterator[pa.RecordBatch]:
        """Links per pair among the rows of a task, added up whenever many have come together."""
        pairs, uses, size = [], [], 0

        def total() -> pa.RecordBatch:
            each, owner = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(owner, weights=np.concatenate(uses), minlength=len(each)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(each), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            pairs.append(batch["pairs"].flatten().to_numpy(zero_copy_only=False))
            uses.append(batch["uses"].flatten().to_numpy(zero_copy_only=False))
            size += len(pairs[-1])
            if size >= at_once:
                yield total()
                pairs, uses, size = [], [], 0
        if size:
            yield total()

    counts = aligned.select("pairs", "uses").mapInArrow(added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def count_links(aligned: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds n_links, n_best (links whose pair is among the most frequent of its B id) and count_sum
    (the pairs' counts over the links), and drops ``pairs`` and ``uses``. ``aligned``: stored rows
    of ``align``, read several times; ``counts``: of another table, by default of these rows."""
    counts = staged(pair_counts(aligned) if counts is None else counts, "pairs")
    kept = [c for c in aligned.columns if c not in ("pairs", "uses", "__row", "n_links", "n_best", "count_sum")]
    sums = ("n_links", "n_best", "count_sum")
    if counts.count() <= SENT_PAIRS:
        table = counts.toArrow().sort_by("pair")
        sent = aligned.sparkSession.sparkContext.broadcast(
            tuple(table[c].to_numpy().astype(k) for c, k in (("pair", np.int64), ("n", np.int64), ("best", bool))))
        rest = aligned.select(*kept, "pairs", "uses")

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in batches:
                stops = np.asarray(batch["pairs"].value_lengths().fill_null(0)).cumsum()
                uses = batch["uses"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = batch["pairs"].flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                each = [uses, uses * (best[at] & there) if len(known) else uses * 0, uses * n[at] * there if len(known) else uses * 0]
                yield pa.RecordBatch.from_arrays(
                    [batch[c] for c in kept] + [pa.array(np.diff(np.r_[0, x.cumsum()][stops], prepend=0)) for x in each], names=[*kept, *sums])

        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name in kept]
        return rest.mapInArrow(summed, ", ".join([*kinds, *(f"{c} long" for c in sums)]))
    salted = counts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = (aligned.select("__row", F.explode(F.arrays_zip("pairs", "uses")).alias("x"))
            .select("__row", F.col("x.pairs").alias("pair"), F.col("x.uses").cast("long").alias("uses"),
                    F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int").alias("__salt"))
            .join(salted, ["pair", "__salt"], "left")
            .groupBy("__row").agg(F.sum("uses").alias("n_links"), F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("uses") * F.coalesce("n", F.lit(0))).alias("count_sum")))
    return aligned.select("__row", *kept).join(each, "__row", "left").select(
        *kept, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums))
