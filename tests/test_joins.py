"""Joins of growing tables, whose files say little about their rows in memory."""

import pytest
from helpers import day
from pyspark.sql import functions as F

from checks import supplied as sup
from checks.queries import QUERIES
from pricetrail.operators import changes
from pricetrail.plans import joins
from pricetrail.plans.joins import join_large

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_small_files_is_not_broadcast(spark):
    left, right = (spark.range(20).withColumn(c, F.lit(c)) for c in ("a", "b"))
    assert "Broadcast" in plan(left.join(right, "id"))
    joined = join_large(left, right, "id", "left")
    assert "Broadcast" not in plan(joined) and joined.count() == 20


@pytest.mark.parametrize("name", ["fake_sales", "shrinkflation"])
def test_reports_join_all_products_by_shuffle(spark, name, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 100)
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SF_DIR))


def test_observations_join_many_products_by_shuffle(spark, monkeypatch):
    assert "BroadcastHashJoin" in plan(sup.observations(spark, SF_DIR))
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 100)
    assert "BroadcastHashJoin" not in plan(sup.observations(spark, SF_DIR))


def test_shrinkflation_keeps_changes_of_known_products_only(spark):
    fields = "id long, product_id long, old_unit string, new_unit string, detected_at timestamp_ntz"
    found = spark.createDataFrame([(1, 7, "1 l", "2 l", day(2)), (2, 8, "1 l", "2 l", day(3))], fields)
    known = spark.createDataFrame(
        [(7, "N", "ah", "c")], "id long, name string, supermarket string, category string"
    )
    assert [r.id for r in changes.shrinkflation(known, found).collect()] == [1]
