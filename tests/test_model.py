"""Rates, preparation, model, scoring and monitoring on the smallest tables."""

from datetime import date

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lagwatch import constants as C
from lagwatch.operators import contributions as con
from lagwatch.operators import forest
from lagwatch.operators import preparation as prep
from lagwatch.operators.joins import duplicate_keys, join_itineraries, lookup
from lagwatch.operators.rates import fit_rates
from lagwatch.operators.temporal_split import assign_block, fold_cuts
from lagwatch.plans import monitoring, scoring, training
from lagwatch.session import concurrently, scratch_path
from lagwatch.sources.stores import ModelRegistry
from workload import queries as Q
from workload import views as V

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return Q.fitted(spark, D)


def test_rates_do_not_see_later_outcomes(spark):
    rows = Q.split_rows(spark, D)
    flipped = rows.withColumn(C.TARGET, F.when(F.col("split") == "train", F.col(C.TARGET)).otherwise(1 - F.col(C.TARGET)))
    train = F.col("split") == "train"
    one, two = fit_rates(rows.where(train)), fit_rates(flipped.where(train))
    assert one.global_rate == two.global_rate
    assert sorted(map(repr, one.table.collect())) == sorted(map(repr, two.table.collect()))


def test_unseen_and_missing_keys_get_the_global_rate(spark):
    train = spark.createDataFrame([("a", "r", 1), ("a", "r", 0), ("b", None, 0), (None, "r", 1)],
                                  f"carrier string, region string, {C.TARGET} int")
    rates = fit_rates(train)
    assert rates.global_rate == 0.5 and rates.sizes == {"carrier": 2, "region": 1, "carrier_region": 1, "global": 1}
    rows = spark.createDataFrame([("a", "r"), ("z", "r"), (None, None)], "carrier string, region string")
    got = {r["carrier"]: r for r in rates.apply(rows).collect()}
    assert got["a"]["tasa_fallo_carrier"] == 0.5 and got["z"]["tasa_fallo_carrier"] == 0.5
    assert got["z"]["tasa_fallo_region"] == pytest.approx(2 / 3) and got[None]["tasa_fallo_region"] == 0.5


def test_salted_lookup_equals_plain(spark, monkeypatch):
    facts = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(map(tuple, lookup(facts, table, ["k"]).collect()), key=repr)
    monkeypatch.setattr("lagwatch.operators.joins.BROADCAST_BYTES", 1)
    salted = sorted(map(tuple, lookup(facts, table, ["k"], salt_by="id").collect()), key=repr)
    assert plain == salted and duplicate_keys(facts, ["k"]).count() == 7


def test_one_hot_of_rare_and_unseen(spark):
    train = spark.createDataFrame([("a", 1.0, 1)] * 12 + [("b", None, 0)] * 3,
                                  f"carrier string, mes double, {C.TARGET} int")
    fitted = prep.fit_preparer(train, ["carrier", "mes"])
    names = [r["name"] for r in fitted.slot_names().orderBy("position").collect()]
    assert names == ["num__mes", "cat__carrier_a", f"cat__carrier_{prep.INFREQUENT}"]
    rows = spark.createDataFrame([("a", None), ("b", 1.0), ("z", 2.0)], "carrier string, mes double")
    got = {r["carrier"]: r["features"].toArray().tolist() for r in fitted.transform(rows, encoding="one_hot").collect()}
    assert got == {"a": [0.0, 1.0, 0.0], "b": [0.0, 0.0, 1.0], "z": [1.0, 0.0, 0.0]}


def test_planted_signal_is_learnt(spark, model):
    data, fitted, _ = model
    scored = fitted.predict(data.part("test"))
    rows = training.evaluate(scored).collect()
    assert rows[0]["roc_auc"] > 0.52 and len(rows) == 3
    low, high = scored.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0 <= low <= high <= 1


def test_encoding_does_not_depend_on_the_number_of_levels(spark):
    few = [("a", 1)] * 12 + [("b", 0)] * 12 + [("c", 1), ("d", 0)]
    schema = f"carrier string, {C.TARGET} int"
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "carrier string")
    many = few + [(f"level{i:04d}", i % 2) for i in range(600) for _ in range(10)]
    for data in (few, many):
        fitted = prep.fit_preparer(spark.createDataFrame(data, schema), ["carrier"])
        got = {r["carrier"]: r["features"].toArray().tolist() for r in fitted.transform(rows).collect()}
        assert got == {"a": [1.0], "b": [0.0], "c": [0.5], "z": [0.5]}
        hot = {r["carrier"]: r["features"].toArray().nonzero()[0].tolist() for r in fitted.transform(rows, encoding="one_hot").collect()}
        assert hot == {"a": [0], "b": [1], "c": [fitted.slots["carrier"] - 1], "z": []}
        assert fitted.slot_names().count() == fitted.width


def test_lookup_of_a_hot_and_a_missing_key(spark, monkeypatch):
    facts = spark.range(600).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 3 = 0 THEN NULL ELSE concat('k', id % 7) END AS k")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3)], "k string, v int")
    plain = sorted(map(tuple, lookup(facts, table, ["k"]).collect()))
    monkeypatch.setattr("lagwatch.operators.joins.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, lookup(facts, table, ["k"], share=0.5).collect())) == plain
    assert sorted(map(tuple, lookup(facts, table, ["k"], share=0.0).collect())) == plain


def test_itinerary_join_keeps_packages_single(spark):
    packages = spark.createDataFrame([("1", "p1"), ("2", "p2"), (None, "p3")], "order_id string, package_id string")
    features = spark.createDataFrame([("F1", 4), ("F2", 5), ("F2", 6), (None, 9)], "order_id string, num_ops int")
    mapping = spark.createDataFrame([("F1", "1"), ("F2", "1"), ("F1", "1"), ("F2", "2"), ("F2", None), (None, "2")], "order_id string, order_compra string")
    got = {r["package_id"]: r["num_ops"] for r in join_itineraries(packages, features, mapping).collect()}
    assert got == {"p1": 4, "p2": 5, "p3": None}


def test_leave_one_out_takes_the_row_out_of_its_rate(spark):
    train = spark.createDataFrame([("a", "r", 1), ("a", "r", 0), ("b", "s", 1)],
                                  f"carrier string, region string, {C.TARGET} int")
    rows = fit_rates(train).apply(train, target=C.TARGET).collect()
    got = {(r["carrier"], r[C.TARGET]): r["tasa_fallo_carrier"] for r in rows}
    assert got == {("a", 1): 0.0, ("a", 0): 1.0, ("b", 1): pytest.approx(2 / 3)}
    few = fit_rates(train, min_count=2)
    assert few.sizes == {"carrier": 1, "region": 1, "carrier_region": 1, "global": 1}


def test_registry_round_trip_and_latest(spark, model):
    data, fitted, _ = model
    registry = ModelRegistry(spark, scratch_path(spark, "models"))
    assert registry.latest() is None
    assert registry.save(fitted, date(2026, 3, 4)) == "v1_2026-03-04"
    assert registry.save(fitted, date(2026, 3, 5)) == "v2_2026-03-05" == registry.latest()
    val = data.part("val").select("package_id", *fitted.preparer.raw_features)
    loaded = registry.load()
    total = [m.predict(val).agg(F.sum("risk_score")).first()[0] for m in (fitted, loaded)]
    assert total[0] == pytest.approx(total[1]) and loaded.version == "v2_2026-03-05"


def test_batch_scoring_with_factors_and_errors(spark, model):
    _, fitted, typical = model
    queries = V.scoring_queries(spark, D).limit(40).withColumn(
        "order_id", F.when(~F.col("package_id").endswith("7"), F.col("order_id")))
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    out = scoring.score_queries(queries, fitted, Q.at(Q.LOG_AS_OF), typical=typical).collect()
    assert len(out) == 40
    errors = [r for r in out if r["predicted_outcome"] == "error"]
    assert all(r["risk_score"] == 0 and r["disruption_type"] == "processing_error" for r in errors)
    good = [r for r in out if r["predicted_outcome"] != "error"]
    assert good and all(len(r["contributing_factors"]) == 3 and r["disruption_type"] for r in good)


def test_train_score_log_monitor(spark, model):
    data, fitted, _ = model
    at = Q.at("2001-08-01 00:00:00")
    rates = data.rates
    log = scoring.prediction_log(scoring.query_features(V.scoring_queries(spark, D), rates), fitted, at)
    outcomes = data.rows.select("package_id", F.col(C.TARGET).alias("outcome"))
    log = scoring.fill_outcomes(log, outcomes)
    reference = monitoring.learn_reference(data.part("train"), Q.DRIFT_FEATURES)
    report = monitoring.monitor(log, reference, Q.DRIFT_FEATURES, at).first()
    assert report["n_labelled"] == data.rows.count()
    assert report["category_trigger"] and report["new_values"] > 0 and report["should_retrain"]
    assert any(text.startswith("Nuevas categorías") for text in report["reasons"])


def test_occlusion_of_a_typical_row_is_zero(spark, model):
    data, fitted, typical = model
    row = data.part("val").limit(1).withColumns({
        k: F.lit(v).cast(data.rows.schema[k].dataType) for k, v in typical.items()})
    values = fitted.contributions(fitted.preparer.transform(row), "package_id", typical).collect()
    assert len(values) == len(typical) and all(abs(r["contribution"]) < 1e-9 for r in values)


def test_tree_contributions_equal_scoring_every_variant(spark, model):
    data, fitted, typical = model
    prepared = fitted.preparer.transform(data.rows.limit(400)).select("package_id", "features")
    whole = con.occlusion(prepared, fitted.score, "package_id", fitted.preparer.raw_features, fitted.encoded_typical(typical))
    want = {(r["package_id"], r["feature"]): r["contribution"] for r in whole.collect()}
    got = {(r["package_id"], r["feature"]): r["contribution"] for r in fitted.contributions(prepared, "package_id", typical).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12
    margins = forest.with_contributions(
        fitted.score(prepared).select("package_id", "margin", vector_to_array("features").alias("_x")),
        fitted.forest, fitted.encoded_typical(typical), margin="again").collect()
    assert max(abs(r["margin"] - r["again"]) for r in margins) < 1e-12


def test_factors_of_a_row_equal_those_of_the_long_form(spark, model):
    data, fitted, typical = model
    rows = fitted.explained(fitted.preparer.transform(data.rows.limit(200)).select("package_id", "features"), typical)
    long = con.long_contributions(rows, "package_id", fitted.preparer.raw_features)
    one = {r[0]: r[1] for r in rows.select("package_id", con.row_factors(F.col("contributions"), fitted.preparer.raw_features)).collect()}
    assert one == {r[0]: r[1] for r in con.top_factors(long, "package_id").collect()}


def test_small_trees_by_hand(spark):
    trees = forest.Forest.of([[(0, 0, 1.0, 1, 2, 0.0), (1, -1, 0, 0, 0, 5.0), (2, 1, 2.0, 3, 4, 0.0), (3, 0, 3.0, 5, 6, 0.0),
                               (4, -1, 0, 0, 0, 9.0), (5, -1, 0, 0, 0, 1.0), (6, -1, 0, 0, 0, 2.0)], [(0, -1, 0, 0, 0, 7.0)]], [2.0, 1.0])
    rows = spark.createDataFrame([(1, [0.5, 9.0]), (2, [4.0, 0.0]), (3, [4.0, 9.0]), (4, None), (5, [float("nan"), 0.0]), (6, [2.0, 2.5])],
                                 "id int, _x array<double>").repartition(2)
    got = {r["id"]: (r["m"], r["contributions"]) for r in forest.with_contributions(rows, trees, [2.0, 2.5], margin="m").collect()}
    assert got == {1: (17.0, [-8.0, 0.0]), 2: (11.0, [2.0, -14.0]), 3: (25.0, [0.0, 0.0]), 4: (None, None), 5: (11.0, [2.0, -14.0]), 6: (25.0, [0.0, 0.0])}
    assert forest.with_contributions(rows.limit(0), trees, [2.0, 2.5]).collect() == []


def test_jobs_side_by_side_keep_order_and_raise(spark):
    assert concurrently(spark, [lambda k=k: spark.range(k).count() for k in (3, 1, 2)]) == [3, 1, 2]
    assert concurrently(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        concurrently(spark, [lambda: 1 // 0, lambda: spark.range(10).count()])


def test_a_fold_learns_from_its_past_only(spark, model):
    train = model[0].part("train")
    found = {r["fold"]: r for r in training.cross_validate(train, model[1].preparer.raw_features, params={"trees": 2, "depth": 2}).collect()}
    blocks = dict(assign_block(train, fold_cuts(train)).groupBy("block").count().collect())
    assert {k: r["n"] for k, r in found.items()} == {k: n for k, n in blocks.items() if k >= 0}
