"""Similarity self-join of documents on word n-grams, by rare-first prefixes.

1. Documents with the same set of n-grams form one class; only classes go on.
2. One total order of n-grams, rare first: occurrences over all documents are counted in
   ``1 << CELL_BITS`` hashed cells, a table of fixed size. Any order is exact; the counts only decide
   how rare the n-grams of a prefix are.
3. Two sets of the asked similarity share an n-gram in their prefixes, the first n - ceil(t n) + 1
   n-grams in that order. Prefix n-grams are posted with the set's size and the position.
4. Sets that meet in a short list are paired at once; in a longer list each set is paired with
   the hubs of its size, those with the fewest rarer n-grams. Pairs pass the length filter (sizes),
   the positional filter (how many n-grams can still be common) and the suffix filter (how
   the n-grams of both sets fall on hashed parts bounds their difference), and each is verified once.
5. Sets linked so far are one component, and pairs within it need no check. Lists that hold more
   than one component are taken up again: all pairs across components, in blocks of bounded size,
   through the same filters, verified once. No list is cut short.

Frequent n-grams are dealt over salted lists in step 4, and lists are met in blocks in step 5, so
no task holds a whole hot list. All rows of a salted n-gram go on to step 5 as one list, however
few a salt has, as sets under different salts meet only there.

Defined cases: a null text, or one without a word, is an empty set, linked with nothing; a text
with fewer words than n is one n-gram of all its words; rows that share an id and a set are one
class; a null id never names a component unless all of the component lacks an id, and is linked as any
other; an empty table gives no row. n-grams are 64-bit hashes, classes 128-bit hashes of their sorted sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import held, id_and_text, staged, with_row_key
from lagwatch.llm.components import components
from lagwatch.llm.decontamination import shingle_hashes

CELL_BITS = 22
CHUNK = 1 << 16
SHORT_LIST = 4       # lists up to here are paired at once
LIST_ROWS = 20_000   # rows of a salted list
BLOCK_ROWS = 2_048   # sets of a block in step 5
GROUP_PAIRS = 64     # pairs checked beside one copy of the set they share
SENT_ROWS = 1_000_000
PARTS = 64           # parts of the suffix filter
REMEMBERED = 200_000  # word hashes a worker keeps


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def occurrences(text: str | None, n: int) -> np.ndarray:
    """Hashes of the n-grams of a text, in order and with repeats."""
    if not text:
        return np.empty(0, np.uint64)
    known = held("words", _Words)
    if len(known) > REMEMBERED:
        known.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.array([known[w] for w in words], np.uint64)
    return shingle_hashes(hashes, min(n, len(words))) if words else hashes


@dataclass(frozen=True)
class Rule:
    """Links sets with den * intersection >= num * union."""

    n: int = 4
    num: int = 85
    den: int = 100

    def need(self, a, b):
        """Smallest intersection of two linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size: int) -> int:
        return size - (-(-self.num * size // self.den)) + 1

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def positions_fit(self, a, pos_a, b, pos_b):
        return 1 + np.minimum(a - pos_a - 1, b - pos_b - 1) >= self.need(a, b)

    def parts_fit(self, a, parts_a, b, parts_b):
        """Sets with an intersection c differ in a + b - 2c n-grams, at least as many as their
        parts differ in."""
        apart = np.abs(parts_a.astype(np.int32) - parts_b.astype(np.int32)).sum(axis=-1)
        return (a + b - apart) // 2 >= self.need(a, b)


def _cells(docs: DataFrame, n: int) -> np.ndarray:
    """Scaled logarithm of the n-grams of all documents that fall on each hashed cell."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch["text"].to_pylist():
                held.append(occurrences(text, n))
                size += len(held[-1])
                if size > 2_000_000:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
                    held, size = [], 0
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        chunks = [zlib.compress(total[a:a + CHUNK].astype("<u4" if total.max() < 1 << 32 else "<u8").tobytes(), 1)
                  for a in range(0, len(total), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                raw = zlib.decompress(counts)
                part = np.frombuffer(raw, "<u4" if len(raw) == 4 * CHUNK else "<u8").astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        rows = sorted(sums)
        scaled = [np.round(256 * np.log2(sums[c] + 1.0)).astype("<u2").tobytes() for c in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(scaled, pa.binary())], names=["chunk", "counts"])

    chunks = (docs.select("text").mapInArrow(counted, "chunk int, counts binary")
              .repartition((1 << CELL_BITS) // CHUNK, "chunk").mapInArrow(summed, "chunk int, counts binary").collect())
    out = np.zeros(1 << CELL_BITS, np.uint16)  # 8 MB
    for r in chunks:
        out[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, "<u2")
    return out


def _signature(sorted_set: np.ndarray) -> tuple[int, int]:
    import xxhash
    value = xxhash.xxh3_128_intdigest(sorted_set.tobytes())
    half = (1 << 64) - 1
    return tuple(x - (1 << 64) if x >> 63 else x for x in (value >> 64, value & half))


def _classes(docs: DataFrame, rule: Rule, cells: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __i, __h, size, high, low) per document, and per class its id, smallest document, the
    row key (__i, __h) of the document that stands for it, size, prefix, list salts and parts."""
    sent = docs.sparkSession.sparkContext.broadcast(cells)
    schema = "doc_id long, __h long, size int, high long, low long, prefix binary, salts binary, parts binary"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["doc_id", "__h", "size", "high", "low", "prefix", "salts", "parts"]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, top = sent.value, np.uint64(64 - CELL_BITS)
        for batch in batches:
            out = []
            for key, row, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "__h", "text")), strict=True):
                grams = np.unique(occurrences(text, rule.n))
                if not len(grams):
                    out.append((key, row, 0, 0, 0, b"", b"", b""))
                    continue
                rank = counts[(grams >> top).astype(np.int64)]
                first = np.argsort(rank, kind="stable")[:rule.prefix(len(grams))]  # ties by hash
                salts = np.ceil(np.exp2(np.minimum(rank[first] / 256.0, 60)) / LIST_ROWS)
                parts = np.minimum(np.bincount((grams & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 65535)
                out.append((key, row, len(grams), *_signature(grams), grams[first].tobytes(),
                            np.minimum(salts, 1 << 20).astype("<u4").tobytes(), parts.astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else
                                             [pa.array([], t) for t in types], names=names)

    described_ = staged(docs.mapInArrow(described, schema), "sets").withColumn("__i", F.coalesce("doc_id", F.lit(-1)))
    members = described_.select("doc_id", "__i", "__h", "size", "high", "low")
    classes = (described_.where("size > 0").groupBy("high", "low")
               .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("__i", "__h")).alias("stands"), F.first("size").alias("size"), F.first("prefix").alias("prefix"),
                    F.first("salts").alias("salts"), F.first("parts").alias("parts"))
               .withColumns({"__i": F.col("stands.__i"), "__h": F.col("stands.__h")}).drop("stands")
               .withColumn("cid", F.monotonically_increasing_id()))
    return members, staged(classes, "classes")  # written, so the class ids stay


def _emit(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _postings(classes: DataFrame) -> DataFrame:
    """(gram, salt, cid, size, pos) of each prefix n-gram; the salt is -1 where all its sets are in one list."""
    schema = "gram long, salt int, cid long, size int, pos int"

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                grams = [np.frombuffer(p, "<i8") for p in part["prefix"].to_pylist()]
                salts = np.concatenate([np.frombuffer(s, "<u4") for s in part["salts"].to_pylist()])
                lengths = np.array([len(g) for g in grams])
                cids = np.repeat(part["cid"].to_numpy(), lengths)
                dealt = np.where(salts > 1, cids % salts, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(grams)), pa.array(dealt), pa.array(cids),
                    pa.array(np.repeat(part["size"].to_numpy(), lengths)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]))],
                    names=["gram", "salt", "cid", "size", "pos"])

    return classes.select("cid", "size", "prefix", "salts").mapInArrow(posted, schema)


def _lists(postings: DataFrame, rule: Rule) -> DataFrame:
    """Rows of kind 0, a pair (x, y) to check, and of kind 1, a row of a longer list or of any
    salted one (x: n-gram, y: class, with size and pos)."""
    schema = "kind int, x long, y long, size int, pos int"
    types, names = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["kind", "x", "y", "size", "pos"]

    def steps(size: int) -> int:
        return int(np.log(size) / np.log(rule.den / rule.num))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int]] = []   # (cid, size, pos) of the list while it is short
        hubs: dict[int, tuple[int, int, int]] = {}
        out: list[tuple] = []
        key, long_ = None, False

        def pair(p, q) -> None:
            if p[0] != q[0] and rule.sizes_fit(p[1], q[1]) and rule.positions_fit(p[1], p[2], q[1], q[2]):
                out.append((0, min(p[0], q[0]), max(p[0], q[0]), 0, 0))

        def to_hubs(row) -> None:
            step = steps(row[1])
            for s in (step - 1, step, step + 1):
                if s in hubs:
                    pair(hubs[s], row)
            hubs.setdefault(step, row)
            out.append((1, key[0], row[0], row[1], row[2]))

        def close() -> None:
            if not long_:
                for i, p in enumerate(held):
                    for q in held[i + 1:]:
                        pair(p, q)

        for batch in batches:
            grams, salts = batch["gram"].to_numpy(), batch["salt"].to_numpy()
            cids, sizes, places = batch["cid"].to_numpy(), batch["size"].to_numpy(), batch["pos"].to_numpy()
            split = (grams[1:] != grams[:-1]) | (salts[1:] != salts[:-1])
            starts = np.concatenate([[0], np.flatnonzero(split) + 1])
            ends = np.append(starts[1:], len(grams))
            # a list of one row inside the batch meets nothing, unless it is one of several of its n-gram
            wanted = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(grams)) | (salts[starts] >= 0))
            for s, e in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                here = (int(grams[s]), int(salts[s]))
                if here != key:
                    close()
                    key, held, hubs, long_ = here, [], {}, here[1] >= 0
                for row in zip(cids[s:e].tolist(), sizes[s:e].tolist(), places[s:e].tolist(), strict=True):
                    if long_:
                        to_hubs(row)
                    else:
                        held.append(row)
                        if len(held) > SHORT_LIST:
                            long_ = True
                            for r in held:
                                to_hubs(r)
                            held = []
                if len(out) > 20_000:
                    yield _emit(out, types, names)
                    out = []
        close()
        yield _emit(out, types, names)

    return (postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "pos", "size", "cid")
            .mapInArrow(met, schema))


def _suffix(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose parts allow the similarity, with the documents that stand for them."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("cid").alias(name), F.col("size").alias(f"size_{name}"), F.col("parts").alias(f"parts_{name}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch[f"parts_{s}"].to_pylist()), "<u2").reshape(-1, PARTS) for s in "ab")
                fits = rule.parts_fit(batch["size_a"].to_numpy(), left, batch["size_b"].to_numpy(), right)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "parts_a", "size_b", "parts_b")
            .mapInArrow(kept, "a long, b long"))


def _degrees(pairs: DataFrame) -> DataFrame:
    """(cid, n) of the classes in more than GROUP_PAIRS pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    return staged(ends.groupBy("cid").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PAIRS), "degrees")


def _verify(docs: DataFrame, members: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that are links, by their whole sets. The sets are made anew, once, from the texts of
    the documents that stand for the classes. The class of a pair that is in more pairs is its first;
    its set goes once to each GROUP_PAIRS of them, the other's set once to each pair it is the second of.
    Of rows with the same id and text one is read."""
    def sent(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if small.count() <= SENT_ROWS else small

    degrees = sent(_degrees(pairs))

    def degree(name: str) -> DataFrame:
        return degrees.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"))

    def groups(n: Column) -> Column:
        return F.ceil(F.coalesce(n, F.lit(1)) / GROUP_PAIRS)

    swapped = F.coalesce("n_b", F.lit(0)) > F.coalesce("n_a", F.lit(0))
    dealt = (pairs.join(degree("a"), "a", "left").join(degree("b"), "b", "left")
             .select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("y"),
                     groups(F.greatest("n_a", "n_b")).alias("salts"))
             .select("x", "y", F.pmod(F.xxhash64("y"), F.col("salts")).cast("int").alias("salt")))
    dealt = staged(dealt, "dealt")
    uses = staged(dealt.select(F.col("x").alias("cid"), "x", "salt", F.lit(-1).cast("long").alias("y")).distinct()
                  .unionByName(dealt.select(F.col("y").alias("cid"), "x", "salt", "y")), "uses")
    wanted = staged(uses.select("cid").distinct().join(classes.select("cid", "__i", "__h", "high", "low"), "cid"), "used")
    wanted = sent(wanted)
    key = ["__i", "__h"]
    texts = docs.select(*key, "text")
    again = staged(members.select(*key).join(wanted.select(*key), key, "left_semi").groupBy(*key).count().where("count > 1").select(*key), "again")
    n_again = again.count()
    if n_again:
        again = F.broadcast(again) if n_again <= SENT_ROWS else again
        one = texts.join(again, key, "left_semi").dropDuplicates(key)
        texts = texts.join(again, key, "left_anti").unionByName(one)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for cid, text, high, low in zip(*(batch[c].to_pylist() for c in ("cid", "text", "high", "low")), strict=True):
                grams = np.unique(occurrences(text, rule.n))
                if _signature(grams) != (high, low):
                    continue  # another text under the same row key
                out.append((cid, grams.tobytes()))
                size += len(out[-1][1])
                if size > 8_000_000:
                    yield _emit(out, [pa.int64(), pa.binary()], ["cid", "grams"])
                    out, size = [], 0
            yield _emit(out, [pa.int64(), pa.binary()], ["cid", "grams"])

    names = ["x", "salt", "y", "grams"]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            out = []
            for x, salt, y, raw in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if (x, salt) != key:
                    key, first = (x, salt), np.frombuffer(raw, np.uint64)  # the first set sorts before the others
                if y < 0:
                    continue
                second = np.frombuffer(raw, np.uint64)
                common = len(first) + len(second) - len(np.union1d(first, second))
                if common >= rule.need(len(first), len(second)):
                    out.append((min(x, y), max(x, y)))
            yield _emit(out, [pa.int64(), pa.int64()], ["a", "b"])

    made = texts.join(wanted, key).select("cid", "text", "high", "low").mapInArrow(sets, "cid long, grams binary")
    if uses.count() <= SENT_ROWS:
        made = made.join(F.broadcast(uses), "cid")
    else:  # a set in many pairs goes to several tasks, which share its uses
        copies = F.explode(F.sequence(F.lit(0), groups(F.col("n")).cast("int") - 1))
        made = made.join(degrees, "cid", "left").select("cid", "grams", copies.alias("copy"))
        mine = F.pmod(F.xxhash64("x", "salt", "y"), groups(F.col("n"))).cast("int")
        made = made.join(uses.join(degrees, "cid", "left").select("cid", "x", "salt", "y", mine.alias("copy")), ["cid", "copy"])
    return (made.select(*names).repartition("x", "salt").sortWithinPartitions("x", "salt", "y")
            .mapInArrow(checked, "a long, b long").distinct())


def _across(rows: DataFrame, classes: DataFrame, linked: DataFrame, rule: Rule) -> DataFrame:
    """Pairs across components that meet in a longer list, through all three filters."""
    found = (rows.join(linked.select(F.col("id").alias("y"), "component"), "y", "left")
             .withColumn("component", F.coalesce("component", "y")))
    open_ = (found.groupBy("x").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count("*").alias("n"))
             .where("l <> h").select("x", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    open_ = staged(open_, "open-lists")
    mine = F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (found.join(open_, "x").withColumn("mine", mine).withColumn("other", other)
             .select("x", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "y", "size", "pos", "component")
             .join(classes.select(F.col("cid").alias("y"), "parts"), "y"))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            mine_, y, size, pos, comp = (np.array(c) for c in list(zip(*held, strict=True))[:5])
            parts = np.frombuffer(b"".join(h[5] for h in held), "<u2").reshape(-1, PARTS)
            for p in range(len(held)):
                q = np.arange(p + 1, len(held))
                ok = (comp[q] != comp[p]) & rule.sizes_fit(size[q], size[p]) & rule.positions_fit(size[q], pos[q], size[p], pos[p])
                if key[1] != key[2]:
                    ok &= mine_[q] != mine_[p]
                q = q[ok]
                if len(q):
                    q = q[rule.parts_fit(size[q], parts[q], size[p], parts[p])]
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(y[q], y[p])), pa.array(np.maximum(y[q], y[p]))], names=["a", "b"])

        for batch in batches:
            for x, i, j, *row in zip(*(batch[c].to_pylist() for c in ("x", "i", "j", "mine", "y", "size", "pos", "component", "parts")), strict=True):
                if (x, i, j) != key:
                    yield from close()
                    key, held = (x, i, j), []
                held.append(row)
        yield from close()

    return (dealt.repartition("x", "i", "j").sortWithinPartitions("x", "i", "j", "y")
            .mapInArrow(crossed, "a long, b long").distinct())


@dataclass(frozen=True)
class Joined:
    """``members`` (doc_id, size, high, low) per document; ``classes`` with their ids; verified
    ``links`` (a, b) between classes, enough of them to connect every component."""

    members: DataFrame
    classes: DataFrame
    links: DataFrame


def join(docs: DataFrame, rule: Rule = Rule()) -> Joined:
    docs = with_row_key(id_and_text(docs))
    members, classes = _classes(docs, rule, _cells(docs, rule.n))
    lists = staged(_lists(_postings(classes), rule), "lists")
    pairs = lists.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    first = staged(_verify(docs, members, classes, staged(_suffix(pairs, classes, rule), "pairs"), rule), "links")
    linked = components(first)
    rest = staged(_across(lists.where("kind = 1"), classes, linked, rule), "pairs")
    links = first
    if not rest.isEmpty():
        links = first.unionByName(staged(_verify(docs, members, classes, rest, rule), "links"))
    return Joined(members, classes, links)


def grouped(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, __h (the row key of its text), size, group and component_id of each document. The
    group is any number that the documents of a component share, and null for empty sets."""
    found = join(docs, rule)
    linked = components(found.links)
    ids = found.classes.select("cid", "high", "low", "doc_id")
    named = (ids.join(linked, ids.cid == linked.id, "left")
             .withColumn("group", F.coalesce("component", "cid")).select("high", "low", "doc_id", "group"))
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(least, "group").select("high", "low", "group", "component_id")
    members = found.members
    out = members.where("size > 0").join(by_class, ["high", "low"]).select("doc_id", "__h", "size", "group", "component_id")
    alone = members.where("size = 0").select("doc_id", "__h", "size", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def with_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    return grouped(docs, rule).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
