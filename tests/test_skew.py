"""Large groups are cut into slices; the results must not depend on it."""

import datetime as dt
import random

import pytest
from helpers import day, prices
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetrail.operators import catalog, ingest
from pricetrail.plans.joins import join_small
from pricetrail.plans.skew import large_groups, sliced_rows, with_previous


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; positions are clumped and have gaps."""
    rng = random.Random(3)
    rows = []
    for position in sorted(rng.sample(range(5000), 600) + rng.sample(range(10**12, 10**12 + 900), 300)):
        key = 1 if rng.random() < 0.34 else rng.randint(2, 40)
        rows.append((key, position, rng.choice([None, "a", "b"])))
    return spark.createDataFrame(rows, "k int, pos long, v string").repartition(8)


def plain_lag(df):
    window = Window.partitionBy("k").orderBy("pos")
    return df.withColumn("previous", F.lag(F.struct("v")).over(window))


@pytest.mark.parametrize("slice_rows", [1, 7, 50, 10_000])
def test_previous_value_is_the_same_for_any_slice_size(skewed, slice_rows):
    got = with_previous(skewed, ["k"], ["pos"], ["v"], slice_rows=slice_rows)
    want = plain_lag(skewed)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(
        map(str, want.collect())
    )


def test_all_large_groups_are_found(spark):
    many = spark.range(5000).select((F.col("id") % 2500).alias("k"), F.col("id").alias("pos"))
    assert large_groups(many, ["k"], 1).count() == 2500
    assert large_groups(many, ["k"], 2).count() == 0
    got = with_previous(many, ["k"], ["pos"], ["pos"], slice_rows=1)
    assert got.filter("previous IS NULL").count() == 2500
    assert got.filter("previous.pos = pos - 2500").count() == 2500


def test_slices_hold_equal_numbers_of_rows(spark):
    """A burst at one moment among few rows elsewhere, and several large groups."""
    burst = [(1, 0 if i < 990 else i * 10**9, i) for i in range(1000)]
    others = [(k, i, i) for k in (2, 3, 4, 5, None) for i in range(300)]
    df = spark.createDataFrame(burst + others, "k int, pos long, id long").repartition(8)
    sliced = sliced_rows(df, ["k"], ["pos", "id"], df.count(), 100)
    sizes = sliced.groupBy("k", "_slice").count().collect()
    assert max(r["count"] for r in sizes) <= 100
    rows = sorted(sliced.filter("k = 1").collect(), key=lambda r: (r.pos, r.id))
    assert [r["_slice"] for r in rows] == sorted(r["_slice"] for r in rows)
    got = with_previous(df, ["k"], ["pos", "id"], ["id"], slice_rows=100)
    window = Window.partitionBy("k").orderBy("pos", "id")
    want = df.withColumn("previous", F.lag(F.struct("id")).over(window))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_price_arrays_have_one_form_at_any_size(spark):
    rows = [(i, 1, float(i), dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(800)]
    rows += [(1000, 2, 5.0, day(3))]
    df = prices(spark, rows)
    series = sorted(catalog.price_series(df).collect(), key=lambda r: (r.product_id, r.part))
    assert [(r.product_id, r.part) for r in series][:3] == [(1, 2024), (1, 2025), (1, 2026)]
    assert [len(r.price_history) for r in series[:3]] == [366, 365, 69]
    joined = [e.id for r in series if r.product_id == 1 for e in r.price_history]
    assert joined == list(range(800))
    extract = catalog.price_series(df, min_entries=2)
    assert {r.product_id for r in extract.collect()} == {1}


@pytest.mark.parametrize("slice_rows", [2, 10_000])
def test_price_jumps(spark, slice_rows):
    df = prices(
        spark,
        [(1, 1, 1.0, day(1)), (2, 1, 1.5, day(2)), (3, 1, 0.7, day(3)), (4, 1, 1.06, day(4)),
         (5, 2, 9.0, day(1)), (6, 2, 2.0, day(2)), (7, 2, 2.0, day(2)), (8, 2, 4.0, day(2))],
    )
    got = ingest.flag_price_jumps(df, slice_rows=slice_rows).collect()
    # Half of the price before is not more than half of it.
    assert {(r.id, r.previous_price) for r in got} == {(3, 1.5), (4, 0.7), (6, 9.0), (8, 2.0)}


def test_small_joins_broadcast_only_below_the_bound(spark):
    left = spark.range(100).withColumn("v", F.lit(1))
    right = spark.range(20).withColumn("w", F.lit(2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = join_small(left, right, ["id"], "inner", max_rows=20)
        many = join_small(left, right, ["id"], "inner", max_rows=19)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
    assert few.count() == many.count() == 20
