"""Price changes over time: movers, inflation, permanent sales, pack sizes, price index."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions import exact_mean, moment_key, pct_change, round_half
from pricetrail.operators.catalog import in_category, percent, with_canonical_category
from pricetrail.plans.joins import join_large
from pricetrail.schemas import STORES

MOVER_FIELDS = (
    "id", "name", "supermarket", "category", "unit", "unit_type", "price_per_unit",
    "first_price", "first_date", "latest_price", "latest_date", "pct_change", "abs_change",
)


def since(days: int, as_of: dt.date | None) -> Column:
    """Start of the day `days` before `as_of` (today when not given), for a scan filter."""
    day = F.current_date() if as_of is None else F.lit(as_of)
    return F.date_sub(day, days).cast("timestamp_ntz")


def first_last_prices(
    prices: DataFrame, days: int = 30, as_of: dt.date | None = None
) -> DataFrame:
    """First and last price of every product within the look-back; there is no upper bound.

    One aggregate gives both ends: no sort by time, no self-join, partial results per task.
    """
    key = moment_key(F.col("scraped_at"), F.col("id"))
    return (
        prices.filter(F.col("scraped_at") >= since(days, as_of))
        .groupBy("product_id")
        .agg(
            F.min_by("price", key).alias("first_price"),
            F.min("scraped_at").alias("first_date"),
            F.max_by("price", key).alias("latest_price"),
            F.max("scraped_at").alias("latest_date"),
        )
    )


def changed_prices(prices: DataFrame, days: int = 30, as_of: dt.date | None = None) -> DataFrame:
    """Products whose first and last price differ, with the unrounded change in `pct`."""
    return (
        first_last_prices(prices, days, as_of)
        .filter(F.col("first_price") != F.col("latest_price"))
        .withColumn("pct", pct_change(F.col("first_price"), F.col("latest_price")))
        .withColumnRenamed("product_id", "id")
    )


def _report(
    products: DataFrame,
    prices: DataFrame,
    days: int,
    as_of: dt.date | None,
    min_change: float,
    changed: DataFrame | None = None,
) -> DataFrame:
    changes = changed_prices(prices, days, as_of) if changed is None else changed
    if min_change > 0:
        changes = changes.filter(F.abs("pct") >= min_change)
    difference = F.col("latest_price") - F.col("first_price")
    return (
        join_large(products, changes, "id")
        .withColumn("pct_change", F.coalesce(round_half(F.col("pct"), 2), F.lit(0.0)))
        .withColumn("abs_change", round_half(difference, 2))
        .select(*MOVER_FIELDS)
    )


def price_changes(
    products: DataFrame,
    prices: DataFrame,
    days: int = 30,
    as_of: dt.date | None = None,
    category: str | None = None,
    supermarket: str | None = None,
    min_change: float = 0.0,
    category_map: DataFrame | None = None,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Price changes over the look-back, largest rise first; `min_change` in percent, unrounded.

    Here and below, `changed` is the result of changed_prices, if there is one already.
    """
    if supermarket is not None:
        products = products.filter(F.col("supermarket") == supermarket)
    if category is not None:
        if category_map is None:
            raise ValueError("a category filter needs the category map")
        products = in_category(products, category_map, category)
    report = _report(products, prices, days, as_of, min_change, changed)
    return report.orderBy(F.desc("pct_change"), "id")


def top_movers(
    products: DataFrame,
    prices: DataFrame,
    days: int = 30,
    as_of: dt.date | None = None,
    threshold: float = 10.0,
    rises: int = 50,
    falls: int = 20,
) -> DataFrame:
    """The largest rises and falls, numbered per direction from the most extreme.

    Each map task keeps only its own extremes before the shuffle.
    """
    changes = _report(products, prices, days, as_of, threshold)
    direction = F.when(F.col("pct_change") > 0, "up").when(F.col("pct_change") < 0, "down")
    extreme = Window.partitionBy("direction").orderBy(F.desc(F.abs("pct_change")), "id")
    return (
        changes.withColumn("direction", direction)
        .filter(F.col("direction").isNotNull())
        .withColumn("position", F.row_number().over(extreme))
        .filter(F.col("position") <= max(rises, falls))
        .filter(F.col("position") <= F.when(F.col("direction") == "up", rises).otherwise(falls))
        .orderBy(F.desc("direction"), "position")
    )


def _inflation_measures(with_max: bool) -> list[Column]:
    first, last = F.col("first_price"), F.col("latest_price")
    measures = [
        F.count("*").alias("products"),
        round_half(exact_mean(F.col("pct")), 2).alias("avg_change_pct"),
        F.count_if(last > first).alias("increased"),
        F.count_if(last < first).alias("decreased"),
    ]
    if with_max:
        measures.insert(2, round_half(F.max("pct"), 2).alias("max_increase_pct"))
    return measures


def inflation_by_category(
    products: DataFrame,
    prices: DataFrame,
    category_map: DataFrame,
    days: int = 30,
    as_of: dt.date | None = None,
    changed: DataFrame | None = None,
    category: str | None = None,
) -> DataFrame:
    """Mean and largest change per canonical category, over products that changed."""
    slim = products.select("id", "supermarket", "category")
    if category is not None:
        slim = in_category(slim, category_map, category)
    if changed is None:
        changed = changed_prices(prices, days, as_of)
    changes = join_large(slim, changed, "id")
    return (
        with_canonical_category(changes, category_map)
        .groupBy(F.col("canonical_category").alias("category"))
        .agg(*_inflation_measures(with_max=True))
        .orderBy(F.desc("avg_change_pct"), "category")
    )


def inflation_by_store(
    products: DataFrame,
    prices: DataFrame,
    days: int = 30,
    as_of: dt.date | None = None,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Mean change per store, over products that changed."""
    if changed is None:
        changed = changed_prices(prices, days, as_of)
    return (
        join_large(products.select("id", "supermarket"), changed, "id")
        .groupBy("supermarket")
        .agg(*_inflation_measures(with_max=False))
        .orderBy(F.desc("avg_change_pct"), "supermarket")
    )


def fake_sales(products: DataFrame, prices: DataFrame, min_sale_pct: float = 80.0) -> DataFrame:
    """Products on sale in at least `min_sale_pct` percent (rounded) of three or more prices.

    Prices are aggregated and filtered before products are joined.
    """
    permanent = (
        prices.groupBy(F.col("product_id").alias("id"))
        .agg(
            F.count("*").alias("total_prices"),
            F.sum("is_sale").alias("sale_count"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            exact_mean(F.col("price")).alias("avg_price"),
        )
        .withColumn("sale_pct", percent(F.col("sale_count"), F.col("total_prices"), 1))
        .filter((F.col("total_prices") >= 3) & (F.col("sale_pct") >= min_sale_pct))
    )
    info = products.select("id", "name", "supermarket", "category", "unit")
    return join_large(info, permanent, "id").orderBy(
        F.desc("sale_pct"), F.desc("total_prices"), "id"
    )


def shrinkflation(products: DataFrame, unit_changes: DataFrame) -> DataFrame:
    """Changes of the pack size text, newest first."""
    info = products.select(F.col("id").alias("product_id"), "name", "supermarket", "category")
    return join_large(unit_changes, info, "product_id").orderBy(F.desc("detected_at"), "id")


def price_index(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean price and number of prices per day and store."""
    stores = products.select(F.col("id").alias("product_id"), "supermarket")
    dated = prices.select("product_id", "price", F.to_date("scraped_at").alias("date"))
    return (
        join_large(dated, stores, "product_id")
        .groupBy("date", "supermarket")
        .agg(
            round_half(exact_mean(F.col("price")), 4).alias("avg_price"),
            F.count("*").alias("products"),
        )
    )


def price_index_wide(index: DataFrame, stores: Sequence[str] = STORES) -> DataFrame:
    """The price index as one row per day with a column per store, NULL where absent."""
    return index.groupBy("date").pivot("supermarket", list(stores)).agg(F.first("avg_price"))
