"""What moves through the shuffles of the shared steps."""

import contextlib
import io

import pytest
from pyspark.sql import Row

from lagwatch import constants as C
from lagwatch.operators import joins
from lagwatch.operators.rates import fit_rates
from workload import views as V


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_operations_are_made_after_the_shuffle(spark, shuffled):
    grouped = next(line for line in plan(V.derive_itineraries(spark, "/root/testdata/sf0.001")).splitlines() if "partial_collect_list" in line)
    assert "legType" not in grouped and "l_shipdate" in grouped


def test_a_rate_table_is_repeated_by_the_measured_share_only(spark, shuffled, monkeypatch):
    data = [Row(**{"carrier": f"c{i % 100}" if i % 7 else None, "region": f"r{i % 50}", C.TARGET: int(i % 3 == 0)}) for i in range(1000)]
    train = spark.createDataFrame(data)
    rates = fit_rates(train)
    plain = sorted(map(repr, rates.apply(train).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert max(rates.shares[level] for level in ("carrier", "region", "carrier_region")) < 1 / 8
    rated = rates.apply(train)
    assert "_salt" not in plan(rated)
    assert sorted(map(repr, rated.collect())) == plain
