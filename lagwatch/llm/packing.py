"""Best-fit packing of token pieces into sequences by sums of squares.

Only documents longer than a sequence are cut. Full pieces are sequences of their own; each
other piece goes where the squared counts of open bins per residual gap become smallest: into
an open bin whose gap it fits, or into a new one. Pieces come longest first.

Texts are read and encoded once, and only lengths and checksums go on: a piece is a row of some
forty bytes. The pieces are dealt evenly over tasks of at most ``piece_rows`` on average, whatever
the input, and each task packs its own; a task leaves only a few bins open at its end.

Defined cases: a null or empty text is one piece with the end id; rows that share an id are
packed each for itself; a null id stays null; an empty table gives no row. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import id_and_text, staged
from lagwatch.llm.tokens import encoded

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SquaresPacker:
    """Open bins by residual gap; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        c, n = self.capacity, self.counts
        gaps, after = n[size:c], n[:c - size]
        # change of the sum of squares when a bin of gap g becomes one of gap g - size
        change = 2 * (after - gaps) + 2
        if len(change):
            change[0] = 1 - 2 * gaps[0]  # a bin that is filled is no longer counted
            change = np.where(gaps > 0, change, np.iinfo(np.int64).max)
            best = int(change.argmin())
            if change[best] <= 2 * n[c - size] + 1:
                gap = best + size
                bin_ = self.open[gap].pop()
                n[gap] -= 1
                self._keep(bin_, gap - size)
                return bin_, c - gap
        bin_ = self.bins
        self.bins += 1
        self._keep(bin_, c - size)
        return bin_, 0

    def _keep(self, bin_: int, gap: int) -> None:
        if gap:
            self.open[gap].append(bin_)
            self.counts[gap] += 1


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each encoded document, without its ids."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["doc_id"].to_pylist()
            out: list[tuple] = []
            for key, ids in zip(keys, encoded(tokenizer, batch["text"].to_pylist(), end_id), strict=True):
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a:a + capacity]
                    out.append((key, k, a, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
         piece_rows: int = 32_768) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` in it."""
    pieces = staged(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    tasks = max(1, -(-pieces.count() // piece_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        packer = SquaresPacker(capacity)
        for batch in batches:
            bins, offsets = [], []
            for size in batch["length"].to_pylist():
                bin_, offset = packer.place(size)
                bins.append(base + bin_)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # dealt by every column, so that repeated ids or one common length fall on many tasks; rows
    # equal in all columns are told apart by their place in the staged table
    return (pieces.withColumn("__place", F.monotonically_increasing_id())
            .repartition(tasks, "doc_id", "piece", "__place")
            .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "__place")
            .mapInArrow(place, _PIECES + ", sequence_id long, offset long"))
