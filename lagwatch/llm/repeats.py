"""Exact removal of repeated byte strings with a sparse suffix array.

A byte goes when it is covered by a ``length``-byte string that starts anywhere else too. Every
string of that length (a window) holds an anchor: the position of the smallest hash among its
``gram``-byte substrings, the first on ties. Equal windows have their anchors at the same offset, so
only anchors are compared, about one in a hundred positions:

1. Each task finds the anchors of its documents; an anchor stands for the run of windows that
   chose it, offsets ``lo`` to ``hi`` before it. Anchors whose gram occurs once repeat nothing.
2. Anchors with equal grams, runs and bytes around form a class, found by 128-bit hashes; if it
   has two members or more, all windows of all its members are repeated.
3. Where a gram has several classes, one member of each is compared with the others: the texts from
   the anchors on and, backwards, the texts before them are sorted by deep-shallow sorting. At offset
   o, two windows are equal when the right texts agree in length - o bytes and the left texts in o
   bytes, that is, when they fall in the same runs of both orders.
4. Repeated windows of a document are merged and cut out.

A gram with more classes than ``GROUP_ROWS`` (a passage in very many documents, each time after
another text) is not gathered. Its windows are parted at the middle offset: those of small offsets
all hold the same stretch of the right text, the others of the left text, and only members equal in that
stretch are compared, as groups of their own. What is then still above ``GROUP_ROWS`` is hashed window by
window and counted with map-side aggregation. Positions and hashes are shuffled, and 600 bytes per class of step 3, but not
texts, as long as the rows to bring to them pass a count; beyond it they meet by a shuffle.

Defined cases: a null text has no bytes, and neither it nor a text shorter than the length loses
any; rows that share an id, or have none, are documents of their own, so a repeated row loses all
its windows; an empty table gives no row. Very long texts are read in overlapping pieces. Other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import staged, with_row_key
from lagwatch.llm.suffixes import deep_shallow_order, neighbour_prefixes

PIECE = 1 << 20         # bytes of a text that are hashed at once
GROUP_ROWS = 4_000      # classes of one gram that are sorted together
SENT_GRAMS = 4_000_000  # 64-bit numbers sent to every task at most
SENT_ROWS = 400_000     # rows joined by broadcast at most
_BASE = 0x9E3779B97F4A7C15 | 1
_INDEX = 24             # bits of a position within a piece

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, _BASE, np.uint64), out=up[1:])
        np.multiply.accumulate(np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64), out=down[1:])
        _powers = up, down
    return _powers


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with one anchor."""
    n = len(data)
    if n < length:
        return (np.empty(0, np.int64),) * 3
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x94D049BB133111EB)
    keys = hashes >> np.uint64(_INDEX) << np.uint64(_INDEX) | np.arange(len(hashes), dtype=np.uint64)
    # sliding minimum: of each block's tail and the next block's head
    width = length - gram + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(tails[:windows], heads[width - 1:width - 1 + windows])
    anchors = (least & np.uint64((1 << _INDEX) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return anchors[first], first, np.append(first[1:], windows) - 1


def text_anchors(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, lo, hi, gram hash, class high, class low) of each run of a text."""
    import xxhash
    half, sign = (1 << 64) - 1, 1 << 63
    for piece in range(0, max(len(text) - length + 1, 0), PIECE):
        data = text[piece:piece + PIECE + length - 1]
        for a, p, q in zip(*(x.tolist() for x in window_anchors(np.frombuffer(data, np.uint8), length, gram)), strict=True):
            around = xxhash.xxh3_128_intdigest(data[p:q + length], seed=(a - q) << 32 | a - p)
            numbers = xxhash.xxh3_64_intdigest(data[a:a + gram]), around >> 64, around & half
            yield piece + a, a - q, a - p, *(x - (1 << 64) if x & sign else x for x in numbers)


_ANCHOR = "__i long, __h long, a int, lo int, hi int, gram long, c1 long, c2 long"
_ANCHOR_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_ANCHOR_NAMES = ["__i", "__h", "a", "lo", "hi", "gram", "c1", "c2"]


def _emit(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, h, text in zip(*(batch[c].to_pylist() for c in ("__i", "__h", "text")), strict=True):
                for run in text_anchors(_raw(text), length, gram):
                    out.append((i, h, *run))
                    if len(out) >= 50_000:
                        yield _emit(out, _ANCHOR_TYPES, _ANCHOR_NAMES)
                        out = []
            yield _emit(out, _ANCHOR_TYPES, _ANCHOR_NAMES)

    return keyed.select("__i", "__h", "text").mapInArrow(found, _ANCHOR)


def _repeated_grams(anchors: DataFrame) -> DataFrame:
    """The anchors whose gram occurs twice or more."""
    grams = staged(anchors.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    if grams.count() > SENT_GRAMS:
        return anchors.join(grams, "gram", "left_semi").select(*_ANCHOR_NAMES)
    known = np.sort(grams.toArrow()["gram"].to_numpy())
    sent = anchors.sparkSession.sparkContext.broadcast(known)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams_ = batch["gram"].to_numpy()
            at = np.minimum(np.searchsorted(sent.value, grams_), max(len(sent.value) - 1, 0))
            hit = sent.value[at] == grams_ if len(sent.value) else np.zeros(len(grams_), bool)
            yield batch.filter(pa.array(hit))

    return anchors.mapInArrow(kept, _ANCHOR)


def _beside(rows: DataFrame, keyed: DataFrame, values: list[str]) -> DataFrame:
    """Texts with the list of their rows: by broadcast up to a count, else by shuffle."""
    small = rows.count() <= SENT_ROWS
    lists = rows.groupBy("__i", "__h").agg(F.collect_list(F.struct(*values)).alias("rows"))
    return keyed.join(F.broadcast(lists) if small else lists, ["__i", "__h"])


_MEMBER = "gram long, __i long, __h long, a int, lo int, hi int, n long, before binary, after binary"
_MEMBER_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_MEMBER_NAMES = ["gram", "__i", "__h", "a", "lo", "hi", "n", "before", "after"]
_RUN = "__i long, __h long, first int, last int"
_RUN_TYPES, _RUN_NAMES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["__i", "__h", "first", "last"]


def _members(classes: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """One member of each class with the bytes around its anchor."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, h, text, rows in zip(*(batch[c].to_pylist() for c in ("__i", "__h", "text", "rows")), strict=True):
                raw = _raw(text)
                for r in rows:
                    a, lo, hi = r["a"], r["lo"], r["hi"]
                    out.append((r["gram"], i, h, a, lo, hi, r["n"], raw[a - hi:a][::-1], raw[a:a - lo + length]))
                if len(out) > 5_000:
                    yield _emit(out, _MEMBER_TYPES, _MEMBER_NAMES)
                    out = []
            yield _emit(out, _MEMBER_TYPES, _MEMBER_NAMES)

    return (_beside(classes, keyed, ["gram", "a", "lo", "hi", "n"]).select("__i", "__h", "text", "rows").mapInArrow(cut, _MEMBER))


def repeated_offsets(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: list[bytes], after: list[bytes],
                     length: int) -> np.ndarray:
    """Whether each member's window at each offset equals that of another member of its group."""
    n = len(groups)
    last = int(hi.max()) if n else 0
    result = np.zeros((n, last + 1), bool)
    ranks = []
    for strings in (before, after):
        order = deep_shallow_order(strings, groups)
        ranks.append((order, neighbour_prefixes(strings, groups, order)))
    for offset in range(last + 1):
        valid = (lo <= offset) & (offset <= hi)
        if valid.sum() < 2:
            continue
        runs = []
        for (order, common), need in zip(ranks, (offset, length - offset), strict=True):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(common < need)
            runs.append(run)
        key = (runs[0] * (n + 1) + runs[1])[valid]
        by = key.argsort(kind="stable")
        same = np.concatenate([[False], key[by][1:] == key[by][:-1], [False]])
        twice = np.empty(len(key), bool)
        twice[by] = same[:-1] | same[1:]
        result[np.flatnonzero(valid)[twice], offset] = True
    return result


def _sorted_groups(members: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of members that stand for themselves alone."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            gram, i, h, a, lo, hi, n, before, after = zip(*rows, strict=True)
            _, groups = np.unique(np.array(gram, np.int64), return_inverse=True)
            hit = repeated_offsets(groups, np.array(lo), np.array(hi), list(before), list(after), length)
            out = []
            for k in np.flatnonzero((np.array(n) == 1) & hit.any(axis=1)).tolist():
                edge = np.diff(np.concatenate([[0], hit[k].astype(np.int8), [0]]))
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    out.append((i[k], h[k], a[k] - (e - 1), a[k] - s))
            return _emit(out, _RUN_TYPES, _RUN_NAMES)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in _MEMBER_NAMES), strict=True):
                # only whole groups are compared; a group has at most GROUP_ROWS members
                if len(held) >= 5_000 and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return members.repartition("gram").sortWithinPartitions("gram").mapInArrow(compared, _RUN)


def _parted(members: DataFrame, length: int, gram: int) -> DataFrame:
    """Each member for the offsets below the middle and for those from it on, as members of the groups
    that hold the same stretch there."""
    middle = (length - gram + 1) // 2

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        half, sign = 1 << 64, 1 << 63

        def group(side: int, old: int, stretch: bytes) -> int:
            value = xxhash.xxh3_64_intdigest(stretch, seed=old % half ^ side)
            return value - half if value & sign else value

        for batch in batches:
            out: list[tuple] = []
            for old, i, h, a, lo, hi, n, before, after in zip(*(batch[c].to_pylist() for c in _MEMBER_NAMES), strict=True):
                if lo < middle:
                    top = min(hi, middle - 1)
                    out.append((group(0, old, after[:length - middle + 1]), i, h, a, lo, top, n, before[:top], after))
                if hi >= middle:
                    low = max(lo, middle)
                    out.append((group(1, old, before[:middle]), i, h, a, low, hi, n, before, after[:length - low]))
                if len(out) > 5_000:
                    yield _emit(out, _MEMBER_TYPES, _MEMBER_NAMES)
                    out = []
            yield _emit(out, _MEMBER_TYPES, _MEMBER_NAMES)

    return members.mapInArrow(body, _MEMBER)


def _counted_windows(members: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many classes, window by window."""
    schema = "gram long, offset int, w1 long, w2 long, __i long, __h long, at int, n long"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["gram", "offset", "w1", "w2", "__i", "__h", "at", "n"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        half, sign = (1 << 64) - 1, 1 << 63
        for batch in batches:
            out: list[tuple] = []
            for gram, i, h, a, lo, hi, n, before, after in zip(*(batch[c].to_pylist() for c in _MEMBER_NAMES), strict=True):
                around = before[::-1] + after
                for offset in range(lo, hi + 1):
                    value = xxhash.xxh3_128_intdigest(around[hi - offset:hi - offset + length])
                    w = [x - (1 << 64) if x & sign else x for x in (value >> 64, value & half)]
                    out.append((gram, offset, *w, i, h, a - offset, n))
                if len(out) > 20_000:
                    yield _emit(out, types, names)
                    out = []
            yield _emit(out, types, names)

    rows = staged(members.mapInArrow(windows, schema), "windows")
    twice = rows.groupBy("gram", "offset", "w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("gram", "offset", "w1", "w2")
    return (rows.where("n = 1").join(twice, ["gram", "offset", "w1", "w2"], "left_semi")
            .select("__i", "__h", F.col("at").alias("first"), F.col("at").alias("last")))


def repeated_runs(keyed: DataFrame, length: int = 400, gram: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(__i, __h, first, last): runs of starts of windows that occur elsewhere."""
    anchors = staged(_anchors(keyed, length, gram), "anchors")
    again = _repeated_grams(anchors)
    classes = staged(again.groupBy("gram", "c1", "c2", "lo", "hi").agg(
        F.count("*").alias("n"), F.min(F.struct("__i", "__h", "a")).alias("m")), "classes")
    copied = classes.where("n > 1").select("gram", "c1", "c2", "lo", "hi")
    runs = (again.join(copied, ["gram", "c1", "c2", "lo", "hi"], "left_semi")
            .select("__i", "__h", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last")))
    several = classes.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    open_ = staged(classes.join(several, "gram").select("gram", "k", "m.*", "lo", "hi", "n"), "open-classes")
    members = staged(_members(open_.where(F.col("k") <= group_rows), keyed, length), "members")
    runs = runs.unionByName(_sorted_groups(members, length))
    hot = open_.where(F.col("k") > group_rows)
    if not hot.isEmpty():
        parted = staged(_parted(_members(hot, keyed, length), length, gram), "parted")
        sizes = staged(parted.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "parted-sizes")
        runs = runs.unionByName(_sorted_groups(parted.join(sizes.where(F.col("k") <= group_rows), "gram", "left_semi"), length))
        wide = sizes.where(F.col("k") > group_rows)
        if not wide.isEmpty():
            runs = runs.unionByName(_counted_windows(parted.join(wide, "gram", "left_semi"), length))
    # rows that share an id and a text have the same runs
    return runs.distinct()


def _merged(runs: DataFrame, length: int) -> DataFrame:
    """(__i, __h, start, stop): maximal runs of removed bytes. A document's runs are its own."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, stop = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for i, h, first, last in zip(*(batch[c].to_pylist() for c in _RUN_NAMES), strict=True):
                if (i, h) == key and first <= stop:
                    stop = max(stop, last + length)
                    continue
                if key is not None:
                    out.append((*key, start, stop))
                key, start, stop = (i, h), first, last + length
            yield _emit(out, _RUN_TYPES, ["__i", "__h", "start", "stop"])
        if key is not None:
            yield _emit([(*key, start, stop)], _RUN_TYPES, ["__i", "__h", "start", "stop"])

    return (runs.repartition("__i", "__h").sortWithinPartitions("__i", "__h", "first")
            .mapInArrow(body, "__i long, __h long, start int, stop int"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` without ``text``, with ``kept`` (the bytes that stay), ``n_bytes`` and ``spans``
    (start, stop) of what was removed."""
    keyed = with_row_key(docs.withColumn("text", F.col("text").cast("string")))
    spans = staged(_merged(repeated_runs(keyed.select("__i", "__h", "text"), length, gram, group_rows), length), "spans")
    names = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "spans")]
    small = spans.count() <= SENT_ROWS
    lists = spans.groupBy("__i", "__h").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    beside = keyed.select(*names, "__i", "__h", "text").join(F.broadcast(lists) if small else lists, ["__i", "__h"], "left").select(*names, "text", "spans")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes = [], []
            for text, spans_ in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                raw = _raw(text)
                parts, at = [], 0
                for s in spans_ or ():
                    parts.append(raw[at:s["start"]])
                    at = s["stop"]
                kept.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), batch["spans"]],
                                             names=[*names, "kept", "n_bytes", "spans"])

    return beside.mapInArrow(cut, f"{fields}kept binary, n_bytes long, spans array<struct<start: int, stop: int>>")
