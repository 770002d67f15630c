"""Binary token shards with a minimal perfect hash index from document keys to offsets.

Documents are dealt by ranges of ``doc_id``, so shard order is key order, and each task
streams its sorted rows into one file in the shared folder. A shard holds the raw ids of its
documents in a row, the offset of each document, and an index over its distinct keys: levels
of bits at which exactly one remaining key fell, whose rank is the key's slot. A slot keeps a
fingerprint of its key and the row of its first document, so a lookup reads one bit, one rank,
one slot and one offset, and an absent key is told by its fingerprint.

Shard file, all little-endian::

    ids | offsets u64[rows + 1] | keys i64[rows] | level words u64 | ranks u64 per word
    | fingerprints u64[keys] | slot rows u32[keys] | footer

Defined cases: a null or empty text has only the end id; a row with a null id is stored before
the others of its shard and is not indexed; rows that share an id are stored one after the
other, by text, and the index names the first; an empty table gives no shard. Other columns are ignored.
An id, or null, whose rows outgrow a shard is stored by a hash of the text and goes on over several
shards, equal texts too; each indexes its own rows, and a lookup reads the first of them.
A task that is run again writes a file of another name; the manifest names the valid ones.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwatch.llm.common import id_and_text
from lagwatch.llm.tokens import encoded
from lagwatch.session import scratch_path

_FOOTER = struct.Struct("<8s10Q")
_MAGIC = b"IDSHARD1"
_MANIFEST = "shard int, path string, rows long, null_rows long, ids long, low long, high long"
ROW_BYTES = 32  # what a task keeps of each row of a shard, besides its text
_ROWS = "shard int, row long, doc_id long, start long, n_tokens long, ids_crc32 long"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of integer keys under a seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectIndex:
    """Minimal perfect hash of distinct integer keys, with fingerprints and a row per slot."""

    GAMMA = 2

    def __init__(self, words: np.ndarray, ranks: np.ndarray, sizes: np.ndarray,
                 prints: np.ndarray, rows: np.ndarray) -> None:
        self.words, self.ranks, self.sizes, self.prints, self.rows = words, ranks, sizes, prints, rows
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)

    @classmethod
    def build(cls, keys: np.ndarray, rows: np.ndarray) -> PerfectIndex:
        left, sizes, levels, level = keys, [], [], 0
        while len(left):
            size = -(-max(cls.GAMMA * len(left), 64) // 64) * 64
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
            level += 1
        words = np.concatenate(levels).view("<u8") if levels else np.empty(0, "<u8")
        ones = np.bitwise_count(words).astype(np.uint64)
        index = cls(words, np.cumsum(ones) - ones, np.array(sizes, "<u8"),
                    np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4"))
        slots = index.slots(keys)
        index.prints[slots], index.rows[slots] = mix(keys, 1 << 20), rows
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = self.starts[level] + mix(keys[open_], level) % size
            word, shift = self.words[(bit >> np.uint64(6)).astype(np.int64)], bit & np.uint64(63)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            rank = self.ranks[(bit >> np.uint64(6)).astype(np.int64)] + below
            out[open_[hit]] = rank[hit].astype(np.int64)
            open_ = open_[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; -1 for keys that are not stored."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slots = self.slots(keys)
        known = (slots >= 0) & (self.prints[slots] == mix(keys, 1 << 20))
        return np.where(known, self.rows[slots].astype(np.int64), -1)


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Shard:
    """An open shard file: the index in memory, the ids read by range."""

    def __init__(self, path: str) -> None:
        system, inner = _filesystem(path)
        self.file = system.open_input_file(inner)
        end = self.file.size()
        magic, width, self.n, self.nulls, *places = _FOOTER.unpack(self.file.read_at(_FOOTER.size, end - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.kind = np.dtype(f"<u{width}")
        offsets, keys, sizes, words, ranks, prints, rows = places

        def part(start: int, stop: int, kind: str) -> np.ndarray:
            return np.frombuffer(self.file.read_at(stop - start, start), kind)

        self.offsets, self.keys = part(offsets, keys, "<u8").astype(np.int64), part(keys, sizes, "<i8")
        self.index = PerfectIndex(part(words, ranks, "<u8"), part(ranks, prints, "<u8"), part(sizes, words, "<u8"),
                                  part(prints, rows, "<u8"), part(rows, end - _FOOTER.size, "<u4"))

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the rows from ``first`` to before ``last``."""
        a, b = int(self.offsets[first]) * self.kind.itemsize, int(self.offsets[last]) * self.kind.itemsize
        return np.frombuffer(self.file.read_at(b - a, a), self.kind)


def _write_shard(path: str, tokenizer: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> dict | None:
    from pyspark import TaskContext

    from lagwatch.llm.tokens import encoder
    kind, system, out, keys, lengths, nulls = encoder(tokenizer).kind, None, None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            shard = TaskContext.get().partitionId()
            name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
            system, inner = _filesystem(name)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            out = system.open_output_stream(inner)
        for ids in encoded(tokenizer, batch["text"].to_pylist(), end_id):
            out.write(ids.astype(kind).tobytes())
            lengths.append(len(ids))
        ids_ = batch["doc_id"]
        nulls += ids_.null_count
        keys.append(ids_.fill_null(0).to_numpy(zero_copy_only=False))
    if out is None:
        return None
    keys = np.concatenate(keys).astype("<i8")
    offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype("<u8")
    real = keys[nulls:]  # nulls sort first
    distinct, first = np.unique(real, return_index=True)
    index = PerfectIndex.build(distinct, first + nulls)
    places, at = [], int(offsets[-1]) * kind.itemsize
    for part in (offsets, keys, index.sizes.astype("<u8"), index.words, index.ranks.astype("<u8"),
                 index.prints, index.rows):
        places.append(at)
        out.write(np.ascontiguousarray(part).tobytes())
        at += part.nbytes
    out.write(_FOOTER.pack(_MAGIC, kind.itemsize, len(keys), nulls, *places))
    out.close()
    return {"shard": shard, "path": name, "rows": len(keys), "null_rows": nulls, "ids": int(offsets[-1]),
            "low": int(real[0]) if len(real) else None, "high": int(real[-1]) if len(real) else None}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("rows", pa.int64()),
                             ("null_rows", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


class TokenStore:
    """A written set of shards; ``manifest`` has one row per shard."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
              shard_bytes: int = 64 << 20) -> TokenStore:
        """Encode whole texts and write them in ascending id order, ``shard_bytes`` of text a shard."""
        spark, docs = docs.sparkSession, id_and_text(docs)
        folder = folder or scratch_path(spark, "token-store")
        sizes = docs.groupBy("doc_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.count("*").alias("n"))
        held = F.col("size") + F.col("n") * ROW_BYTES
        total = sizes.agg(F.sum("size").alias("size"), F.max(held).alias("most"), F.sum(held).alias("held")).first()
        size, order = total.size or 0, [F.col("doc_id").asc_nulls_first()]
        if (total.most or 0) > shard_bytes:  # fewer ids than shards
            size = total.held
            wide = [r.doc_id for r in sizes.where(held > shard_bytes).select("doc_id").collect()]
            is_wide = F.when(F.col("doc_id").isNull(), F.lit(None in wide)).otherwise(F.col("doc_id").isin([i for i in wide if i is not None]))
            docs = docs.withColumns({"__hash": F.when(is_wide, F.xxhash64("text")), "__tie": F.when(is_wide, F.monotonically_increasing_id())})
            order += ["__hash", "__tie"]
        dealt = docs.repartitionByRange(max(1, -(-size // shard_bytes)), *order)

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = _write_shard(f"{folder}/shards", tokenizer, end_id, batches)
            if row:
                yield _batch([row], _MANIFEST_ARROW)

        (dealt.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(shards, _MANIFEST)
         .write.parquet(f"{folder}/manifest"))
        return cls(spark, folder)

    def _shards(self) -> DataFrame:
        """The manifest with the ids before each shard. It has one row per shard, so its
        running sum may go through one task."""
        before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        return self.manifest.withColumn("before", F.coalesce(before, F.lit(0)))

    def read(self, block: int = 2000) -> DataFrame:
        """Every stored row with its place and checksum, found through the index of its shard."""
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for entry in batch.to_pylist():
                    shard = Shard(entry["path"])
                    for a in range(0, shard.n, block):
                        b = min(a + block, shard.n)
                        number = np.arange(a, b)
                        keys = shard.keys[a:b]
                        indexed = number >= shard.nulls
                        # the first row of the key, then on by as many rows as share it
                        first = np.where(indexed, shard.index.find(keys), number)
                        if (first < 0).any() or (shard.keys[first] != keys).any():
                            raise ValueError("a stored key is not found by its index")
                        ids, base = shard.ids(a, b).astype("<u4"), int(shard.offsets[a])
                        starts, stops = shard.offsets[number], shard.offsets[number + 1]
                        same = first == number
                        starts[same], stops[same] = shard.offsets[first[same]], shard.offsets[first[same] + 1]
                        crc = [zlib.crc32(ids[s - base:e - base]) for s, e in zip(starts, stops, strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(b - a, entry["shard"], np.int32)), pa.array(number),
                            pa.array(keys, mask=~indexed), pa.array(starts + entry["before"]),
                            pa.array(stops - starts), pa.array(np.array(crc, np.int64))],
                            names=["shard", "row", "doc_id", "start", "n_tokens", "ids_crc32"])

        shards = self._shards()
        return shards.repartition(max(1, shards.count()), "shard").mapInArrow(rows, _ROWS)

    def lookup(self, keys: DataFrame, column: str = "doc_id") -> DataFrame:
        """(key, ids) of the first row of each stored key; keys that are not stored give no row."""
        bounds = [(r.low, r.high, r.path) for r in self.manifest.orderBy("shard").collect() if r.low is not None]
        highs = np.array([b[1] for b in bounds], np.int64)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: dict[str, Shard] = {}
            for batch in batches:
                wanted = np.array([k for k in batch[0].to_pylist() if k is not None], np.int64)
                out: list[tuple[int, list[int]]] = []
                place = np.searchsorted(highs, wanted)
                for p in np.unique(place[place < len(bounds)]):
                    path = bounds[p][2]
                    if path not in open_:
                        open_.clear()  # keys come sorted: one shard at a time
                        open_[path] = Shard(path)
                    shard, asked = open_[path], wanted[place == p]
                    for key, row in zip(asked, shard.index.find(asked), strict=True):
                        if row >= 0:
                            out.append((int(key), shard.ids(row, row + 1).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()),
                                                  pa.array([i for _, i in out], pa.list_(pa.int64()))],
                                                 names=["key", "ids"])

        sorted_ = keys.select(F.col(column).cast("long")).sortWithinPartitions(column)
        return sorted_.mapInArrow(found, "key long, ids array<long>")
