"""Fill-in-middle forms of whole texts.

A text's units are runs of ASCII letters and single other characters, from left to right. Two
cuts, chosen by a hash of the document's id, divide them into prefix, middle and suffix, which are
written in the order that training on infilling asks for, each after its mark.

The cuts are ranks among units; where they fall in the text is found in an indexable skip list
over the units: lane 0 holds every unit, each lane above a share of the one below, and every
link carries how many units and how many code points it spans. From the top lane down, links are
followed as long as the units passed stay within the rank; the code points passed are then the place of
the cut. A node's height comes from a fixed generator, so it is the same for every text and run.

Defined cases: a null text is an empty one; an empty text, a text that holds one of the marks, and a
share of the others stay plain, with null lengths of prefix and middle. A null id is hashed as no
digits. Every row gives one row; rows with the same id and text give the same result. Units are
found in texts of any length as a whole. An empty table gives no rows. Other columns are
ignored. Nothing is shuffled, sent to tasks or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import id_and_text

# The marks of the three parts, and the shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED_BELOW, SUFFIX_FIRST_BELOW = 90, 20

#: A node of a lane stands in the next one with a chance of one in ``1 << LANE_BITS``.
LANE_BITS = 3


@cache
def _heights(size: int) -> np.ndarray:
    """How many lanes above lane 0 each of ``size`` nodes stands in; a longer list starts alike."""
    n = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n ^= n >> np.uint64(31)
    n *= np.uint64(0xBF58476D1CE4E5B9)
    n ^= n >> np.uint64(29)
    heights = np.zeros(size, np.int8)
    for k in range(1, 64 // LANE_BITS):
        taller = (n & np.uint64((1 << (k * LANE_BITS)) - 1)) == 0
        if not taller.any():
            break
        heights[taller] = k
    return heights


class SkipList:
    """Units in order, found by rank. ``lanes`` go from the lowest up; in each, node ``i`` has the
    units and code points of its link to the next node, and the place of the node below it."""

    def __init__(self, lengths: np.ndarray) -> None:
        """``lengths``: the code points of each unit."""
        n = len(lengths)
        heights = _heights(1 << max(n - 1, 0).bit_length())[:max(n - 1, 0)]
        ends = np.r_[0, np.cumsum(lengths)]
        # node 0 is the head, before the first unit; node i stands after unit i; the last link ends at the end
        nodes = np.arange(n)
        self.lanes = [(np.ones(n, np.int64), np.asarray(lengths, np.int64), nodes)]
        level = 1
        while len(nodes) > 1:
            stays = np.r_[True, heights[nodes[1:] - 1] >= level]
            below = np.flatnonzero(stays)
            nodes = nodes[stays]
            stops = np.r_[nodes[1:], n]
            self.lanes.append((stops - nodes, ends[stops] - ends[nodes], below))
            if len(nodes) == 1:
                break
            level += 1

    def place(self, rank: int) -> int:
        """Code points before the unit with this rank (all of them, for the number of units)."""
        node = units = points = 0
        for spans, widths, below in reversed(self.lanes):
            while node < len(spans) and units + spans[node] <= rank:
                units += int(spans[node])
                points += int(widths[node])
                node += 1
            if units == rank:
                break
            node = int(below[node])
        return points


def unit_lengths(text: str) -> np.ndarray:
    """Code points of each unit of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = points | 0x20
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    inside = letter[1:] & letter[:-1]  # not the first letter of its run
    starts = np.flatnonzero(np.r_[True, ~inside]) if len(points) else np.zeros(0, np.int64)
    return np.diff(starts, append=len(points))


def hashed(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from ``seed:doc_id``."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per row: doc_id, n (units), form (``plain``, ``psm`` or ``spm``), prefix_chars,
    middle_chars (code points), output (the transformed text)."""
    h1, h2, h3, h4 = hashed(F.col("doc_id"), seed)
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= TRANSFORMED_BELOW)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, form, h1, h2 in zip(*(batch[c].to_pylist() for c in ("text", "form", "h1", "h2")), strict=True):
                lengths = unit_lengths(text)
                n = len(lengths)
                if form == "plain":
                    out.append((n, None, None))
                    continue
                units = SkipList(lengths)
                first, last = (units.place(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
                out.append((n, first, last - first))
            n, first, middle = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], batch["form"], pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(middle, pa.int64())],
                names=["doc_id", "text", "form", "n", "prefix_chars", "middle_chars"])

    cut = rows.mapInArrow(places, "doc_id long, text string, form string, n long, prefix_chars long, middle_chars long")
    text, first, middle = F.col("text"), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    parts = {PREFIX: F.substring(text, F.lit(1), first), MIDDLE: F.substring(text, first + 1, middle),
             SUFFIX: F.substring(text, first + middle + 1, F.char_length(text))}

    def joined(*marks: str) -> Column:
        return F.concat(*(x for m in marks for x in (F.lit(m), parts[m])))

    output = (F.when(F.col("form") == "psm", joined(PREFIX, SUFFIX, MIDDLE))
              .when(F.col("form") == "spm", joined(SUFFIX, PREFIX, MIDDLE)).otherwise(text))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. No part holds a mark, and no mark can start in one part and
    end in the next, so the first place of a mark is where it was written."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.char_length(one) + len(second) + 1, F.char_length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.char_length(two) + len(MIDDLE) + 1, F.char_length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output))
