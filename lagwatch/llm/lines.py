"""Lines that many documents share, dropped in every document.

Each document's lines are normalised and hashed (two hashes, 96 bits); a key counts once per
document id; only hashes are exploded and shuffled. The keys found in enough documents are
counted. Up to ``SENT_KEYS`` of them (some 50 MB) they are sent to every task, and each document is
put together again in place. Beyond that they are joined back to (document, position) rows, and
the document is put together again from the positions that stay, which shuffles the texts once.
Both ways give the same rows.

Defined cases: a null or empty text is one empty line, which never counts; a null id is one id
like another; rows that share an id count as one document; an empty table gives no row. Other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import fold_ascii, held, let, semi_join_hashes, staged, strip, with_row_key


#: Keys that are sent to every task: 12 bytes each.
SENT_KEYS = 4_000_000


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return fold_ascii(strip(line))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                      sent_keys: int = SENT_KEYS) -> DataFrame:
    """``docs`` with ``text`` of the lines that stay, and ``n_lines`` and ``n_dropped``."""
    keyed = with_row_key(docs)
    keys = F.transform(text_lines(F.col("text")), line_key)
    lines = (keyed.select("doc_id", "__i", "__h", F.posexplode(keys).alias("__pos", "__key"))
             .where(F.char_length("__key") >= max(min_chars, 1))
             .select("doc_id", "__i", "__h", "__pos", F.xxhash64("__key").alias("__a"), F.hash("__key").alias("__b")))
    common = (lines.select("doc_id", "__a", "__b").distinct().groupBy("__a", "__b").count()
              .where(F.col("count") >= min_docs).select("__a", "__b"))
    common = staged(common, "common-lines")
    size = common.count()
    if size <= sent_keys:
        pairs = common.toArrow()
        a, b = pairs["__a"].to_numpy(), pairs["__b"].to_numpy()
        order = a.argsort()
        if len(np.unique(a)) == size:
            return _in_place(docs, keys, a[order], b[order])
    return _joined(docs, keyed, lines, common)


def _in_place(docs: DataFrame, keys: Column, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """Drop the lines whose hashes are in ``a`` (sorted, distinct) with their ``b``."""
    sent = docs.sparkSession.sparkContext.broadcast((a, b))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    hashed = docs.select(*names, "text", F.transform(keys, lambda k: F.when(k != "", F.xxhash64(k))).alias("__a"),
                         F.transform(keys, lambda k: F.hash(k)).alias("__b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lines", tuple)  # nothing is remembered here, and nothing of another operator
        known, second = sent.value
        for batch in batches:
            first = batch["__a"]
            starts = first.offsets.to_numpy() - first.offsets[0].as_py()
            found, other = first.flatten(), batch["__b"].flatten().to_numpy(zero_copy_only=False)
            word = found.is_valid().to_numpy(zero_copy_only=False)
            found = found.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
            hit = word & (known[at] == found) & (second[at] == other) if len(known) else np.zeros(len(found), bool)
            texts = batch["text"].to_pylist()
            total = np.concatenate([[0], np.cumsum(hit)])
            dropped = total[starts[1:]] - total[starts[:-1]]
            for i in np.flatnonzero(dropped):
                stay = ~hit[starts[i]:starts[i + 1]]
                texts[i] = "\n".join([line for line, s in zip(texts[i].split("\n"), stay, strict=True) if s])
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array([t or "" for t in texts], pa.string()),
                 pa.array(np.diff(starts).astype(np.int64)), pa.array(dropped.astype(np.int64))],
                names=[*names, "text", "n_lines", "n_dropped"])

    return hashed.mapInArrow(cut, ", ".join(x for x in (fields, "text string, n_lines long, n_dropped long") if x))


def _joined(docs: DataFrame, keyed: DataFrame, lines: DataFrame, common: DataFrame) -> DataFrame:
    """The same by a join on (document, position)."""
    dropped = (semi_join_hashes(lines, common, ["__a", "__b"], "__i")
               .groupBy("__i", "__h").agg(F.collect_set("__pos").alias("__dropped")))

    def kept(lines_: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col("__dropped"))
        return F.struct(F.size(lines_).cast("long").alias("n"),
                        F.array_join(F.transform(stay, lambda i: F.get(lines_, i)), "\n").alias("text"))

    whole = F.struct(F.size(text_lines(F.col("text"))).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    cut = F.when(F.col("__dropped").isNull(), whole).otherwise(let(text_lines(F.col("text")), kept))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return (keyed.join(dropped, ["__i", "__h"], "left")
            .withColumn("__cut", cut)
            .select(*names, F.col("__cut.text").alias("text"), F.col("__cut.n").alias("n_lines"),
                    F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped")))
