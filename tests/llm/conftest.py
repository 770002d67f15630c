import os
import random
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows(spark):
    """Makes a documents table from (doc_id, text, lang) rows, with further columns if asked."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))

    def make(data, extra=False):
        filled = [(d, t, lang, "src0", len(t or "")) for d, t, lang in data]
        frame = spark.createDataFrame(filled, SCHEMA).repartition(3)
        if extra:  # names that operators use for their own columns
            from pyspark.sql import functions as F
            for name in ("score", "n_lines", "kept", "spans", "component", "size", "word", "length", "row", "a"):
                frame = frame.withColumn(name, F.lit("theirs"))
        return frame
    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, blank and very long texts, ties, repeated rows, missing ids."""
    long_ = " ".join(f"word{i % 977} tail{i % 13}." for i in range(30_000))
    return [(1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, long_, "en"), (5, long_, "de"),
            (6, "one two", "en"), (6, "one two", "en"), (6, "three four five six seven", None), (None, "no id here at all", "fr"),
            (None, None, None), (7, "é́ 日本 ŝ\x00 x", "fr"), (8, "Ünïcode ß İ ǅ 🙂🙂 text", "de"), (9, "same words " * 400, "en"),
            (10, "\n\n\n", None), (11, "A" * 5000, "en")]


@pytest.fixture(scope="session")
def prose():
    """Seeded texts of invented words, with exact and near copies and shared passages."""
    rng = random.Random(int(os.environ.get("TEST_SEED", "11")))
    parts = ["ka", "lo", "mi", "ter", "san", "vu", "rel", "dop", "in", "est", "or", "ul"]
    vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(900)]

    def text(n):
        out = rng.choices(vocabulary, k=n)
        return " ".join(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.03 else "") for w in out)

    docs = [text(rng.randint(1, 260)) for _ in range(60)]
    passage = text(90)
    for k in range(40):
        base = rng.choice(docs[:20]).split(" ")
        kind = k % 4
        if kind == 1 and len(base) > 5:
            base[rng.randrange(len(base))] = "changed"
        elif kind == 2:
            base = [*base[:len(base) // 2], passage, *base[len(base) // 2:]]
        elif kind == 3:
            base = base[: max(1, len(base) - rng.randint(0, 9))]
        docs.append(" ".join(base))
    return [(i, t, "en") for i, t in enumerate(docs)]


@pytest.fixture
def empty(rows):
    return rows([])
