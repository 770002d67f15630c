"""The pipeline and the registered queries on small tables, and what planted cases become."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from lagwatch.llm.queries import QUERIES

from .test_text_operators import check_packed, plain_components, plain_lines
from .test_decontamination import plain_matches
from lagwatch.llm import jaccard

SCHEMA = "item_id long, text string"


def test_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(QUERIES) <= names
    assert [n for n, _ in pipeline.STAGES] == [
        "language_id", "line_dedup", "jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_pipeline_matches_plain_version(spark, rows, prose, tmp_path, monkeypatch):
    items = [(1, " ".join(prose[3][1].split()[:30])), (2, "nowhere to be found in these documents at all")]
    data = [*prose, (200, "12 345 --", "en"), (201, None, "en"), (202, "", None)]
    data += [(210 + k, f"alone {k} {'x' * k} stands\nThe shared line of many.", "en") for k in range(12)]
    data += [(230, prose[5][1], "en"), (231, f"before it {items[0][1]} after it", "en"), (5, prose[5][1], "en")]
    rows(data, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, SCHEMA).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in data if r[1] and re.search(r"[^\W\d_]", r[1])]
    lined = plain_lines(kept, 10)
    kept = [(d, t, x) for (d, _, dropped, t), (_, _, x) in zip(lined, kept, strict=True) if not dropped or t.strip()]
    seen, single = set(), []
    for (d, _, c), r in zip(plain_components(kept, jaccard.Rule(5, 4, 5)), kept, strict=True):
        if d == c and d not in seen:
            seen.add(d)
            single.append(r)
    leaked = {d for d, _, _ in plain_matches(single, items)}
    assert 231 in leaked or 3 in leaked
    final = [r for r in single if r[0] not in leaked]
    assert {r.doc_id for r in found} == {d for d, _, _ in final}
    check_packed(found, final, 2048)


def test_stages_on_odd_and_empty(spark, rows, odd, empty, tmp_path):
    spark.createDataFrame([(1, "one two")], SCHEMA).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
        out = stage(spark, rows(odd, extra=True), str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == list(pipeline.COLUMNS), name
        out.count()


def test_one_row_stays_of_each_group(spark, rows):
    text, near = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(78))
    data = [(5, text, None), (5, text, None), (7, near, None), (None, text, None), (5, "another text under the same id", None),
            (9, "", None), (9, "", None), (None, "two null ids of one text here", None), (None, "two null ids of one text here", None)]
    kept = pipeline.one_of_each_group(spark, rows(data), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("5", text), ("5", "another text under the same id"), ("9", ""), ("9", ""), ("None", "two null ids of one text here")])


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_line_dedup"])
def test_sql_twins(spark, name):
    import duckdb
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    twin = con.sql(entry.oracle_sql()[name])
    columns = sorted(twin.columns)
    mine = entry.queries()[name](spark, folder).select(columns).collect()
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM twin").fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs)
