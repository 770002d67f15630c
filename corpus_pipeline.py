"""A corpus pipeline: each stage reads what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last stage return
the columns of ``documents``; the last returns one row per packed piece.

A stage works on whatever rows its predecessor kept. Columns that a table lacks come as nulls,
further ones are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwatch.llm import decontamination, jaccard, language, lines, packing
from lagwatch.llm.common import documents, small_batches, staged, with_row_key
from lagwatch.llm.queries import tokenizer

# The columns of ``documents``.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` only."""
    small_batches(docs.sparkSession)
    return docs.select([(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows: with a letter, and closer to some language than
    to none. The prototypes come from the rows with a language whose id is not held out."""
    docs = as_documents(docs)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"), 5, 0)))
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") > 0)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more; a document that only had such lines goes. The
    length of a text that changed is counted anew."""
    cut = lines.drop_common_lines(as_documents(docs), min_docs=10)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.where((F.col("n_dropped") == 0) | (F.trim("text") != "")).withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 0.8 of their five-word shingles: the one with the
    smallest id (a null id comes last), and of rows with that id the first by a hash of the text. A
    document without a word stays."""
    docs = with_row_key(as_documents(docs))
    last = F.lit((1 << 63) - 1)
    rows = staged(jaccard.grouped(docs, jaccard.Rule(n=5, num=4, den=5)).where("size > 0").select(
        "group", F.coalesce("doc_id", last).alias("order"), F.coalesce("doc_id", F.lit(-1)).alias("__i"), "__h"), "groups")
    stays = rows.groupBy("group").agg(F.min(F.struct("order", "__i", "__h")).alias("s")).select("group", "s.__i", "s.__h")
    # groups with one row need nothing: what goes is a small part of the documents
    gone = staged(rows.join(stays, ["group", "__i", "__h"], "left_anti").select("__i", "__h").distinct(), "gone")
    again = staged(rows.join(stays, ["group", "__i", "__h"], "left_semi").groupBy("__i", "__h").count().where("count > 1").select("__i", "__h"), "again")

    def among(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if frame.count() <= GONE_ROWS else frame

    kept = docs.join(among(gone), ["__i", "__h"], "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    # rows with the same id and text: one of them stays
    twice = (kept.join(among(again), ["__i", "__h"], "left_semi").groupBy("__i", "__h")
             .agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*"))
    return kept.join(among(again), ["__i", "__h"], "left_anti").select(*COLUMNS).unionByName(twice)


#: Ids that are sent to every task at most; beyond it they are joined by shuffle.
GONE_ROWS = 2_000_000


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no item of the benchmark."""
    return decontamination.decontaminate(as_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer(), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", line_dedup),
    ("jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Language vectors, fingerprints and packing order have no SQL form; the tests hold the pipeline
#: against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
