"""From observations to the catalog and the price history.

Observations carry `seq`, their arrival number, unique over all runs. It decides every "first" and
"last" here, and it numbers new products, prices and unit changes, so that a repeated run gives
the same ids without a global sort.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pricetrail.functions import missing
from pricetrail.operators import identity
from pricetrail.plans.skew import SLICE_ROWS, with_previous
from pricetrail.schemas import DERIVED_PRODUCT_COLUMNS, MAX_JUMP, MAX_PRICE, PRODUCTS

ATTRIBUTES = ("brand", "category", "unit", "url")


def add_missing_columns(products: DataFrame) -> DataFrame:
    """Catalogs written before normalization existed get its columns as NULL."""
    absent = {
        field.name: F.lit(None).cast(field.dataType)
        for field in PRODUCTS.fields
        if field.name in DERIVED_PRODUCT_COLUMNS and field.name not in products.columns
    }
    return products.withColumns(absent) if absent else products


def price_reject_reason(price: Column) -> Column:
    """Why a price is not stored, NULL for a price that is."""
    return (
        F.when(price.isNull() | F.isnan(price), "price_missing")
        .when(price <= 0, "price_not_positive")
        .when(price > MAX_PRICE, "price_too_high")
    )


def valid_prices(observations: DataFrame) -> DataFrame:
    """Rows with a price to store. NaN sorts above all numbers, so it fails the upper bound."""
    return observations.filter((F.col("price") > 0) & (F.col("price") <= MAX_PRICE))


def rejected_prices(observations: DataFrame) -> DataFrame:
    return observations.withColumn("reason", price_reject_reason(F.col("price"))).filter(
        F.col("reason").isNotNull()
    )


def default_original_price(observations: DataFrame) -> DataFrame:
    """An absent or zero original price is the price itself; an absent sale flag is 0."""
    original = F.coalesce(F.nullif("original_price", F.lit(0.0)), "price")
    return observations.withColumn("original_price", original).withColumn(
        "is_sale", F.coalesce(F.col("is_sale").cast("int"), F.lit(0))
    )


def clean_false_sales(prices: DataFrame) -> DataFrame:
    """No sale without an original price that differs from the price."""
    no_discount = F.col("original_price").isNull() | (F.col("original_price") == F.col("price"))
    return prices.withColumn("is_sale", F.when(no_discount, 0).otherwise(F.col("is_sale")))


def resolve_products(observations: DataFrame, products: DataFrame) -> DataFrame:
    """Give every observation its product, against the stored catalog and within the batch.

    Adds `product_id`, `stored_unit` (of a product already in the catalog), `is_new` (this row
    creates the product) and `reason` ("duplicate_name" where the row may neither join nor create
    a product, "name_missing" without name or store). The result is that of taking the rows one by
    one in order of `seq`: by url, then by name, store and unit, then by name and store where the
    product has no url, each with the url and unit that the rows before have left.
    """
    return identity.resolve(observations, products)


def duplicate_names(resolved: DataFrame) -> DataFrame:
    """Observations that would break the uniqueness of (name, supermarket)."""
    return resolved.filter(F.col("reason") == "duplicate_name")


def upsert_products(resolved: DataFrame, products: DataFrame) -> DataFrame:
    """The catalog after a batch: attributes of the last observation win, NULLs included."""
    products = add_missing_columns(products)
    placed = resolved.filter(F.col("product_id").isNotNull())
    changes = placed.groupBy(F.col("product_id").alias("id")).agg(
        F.max(F.struct("seq", *ATTRIBUTES)).alias("_last"),
        F.min(F.when(F.col("is_new"), F.struct("seq", "name", "supermarket", "scraped_at"))).alias(
            "_created"
        ),
    )
    touched = products.join(changes, "id", "left")
    kept = touched.select(
        *(
            F.when(F.col("_last").isNotNull(), F.col(f"_last.{name}"))
            .otherwise(F.col(name))
            .alias(name)
            if name in ATTRIBUTES
            else F.col(name)
            for name in PRODUCTS.fieldNames()
        )
    )
    created = {
        "id": F.col("id"),
        "name": F.col("_created.name"),
        "supermarket": F.col("_created.supermarket"),
        "created_at": F.col("_created.scraped_at"),
        **{name: F.col(f"_last.{name}") for name in ATTRIBUTES},
    }
    added = changes.filter(F.col("_created").isNotNull()).select(
        *(
            created.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in PRODUCTS.fields
        )
    )
    return kept.unionByName(added)


def first_price_per_day(observations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First valid price of each product and day, unless that day is already stored.

    `observations` need `product_id`. The result has the columns of the price table.
    """
    fields = ("price", "original_price", "is_sale", "scraped_at")
    firsts = (
        default_original_price(valid_prices(observations))
        .filter(F.col("product_id").isNotNull())
        .groupBy("product_id", F.to_date("scraped_at").alias("day"))
        .agg(F.min("seq").alias("id"), *(F.min_by(name, "seq").alias(name) for name in fields))
    )
    if stored is not None:
        days = stored.select("product_id", F.to_date("scraped_at").alias("day"))
        firsts = firsts.join(days, ["product_id", "day"], "left_anti")
    return firsts.select("id", "product_id", *fields)


def flag_price_jumps(prices: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Price rows that moved by more than half of the price before; the rows stay stored."""
    before = F.col("before.price")
    ratio = F.when(before > 0, F.abs(F.col("price") - before) / before)
    return (
        with_previous(
            prices.select("id", "product_id", "price", "scraped_at"),
            keys=["product_id"],
            order=["scraped_at", "id"],
            values=["price"],
            name="before",
            slice_rows=slice_rows,
        )
        .withColumn("change_ratio", ratio)
        .withColumn("previous_price", before)
        .filter(F.col("change_ratio") > MAX_JUMP)
        .drop("before")
    )


def detect_unit_changes(resolved: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Changes of the unit text from one observation of a product to the next.

    A product's first observation is compared with the unit stored for it (`stored_unit`, if the
    frame has it). An observation without unit hides a change, as it overwrites the stored unit.
    """
    if "stored_unit" not in resolved.columns:
        resolved = resolved.withColumn("stored_unit", F.lit(None).cast("string"))
    ordered = with_previous(
        resolved.filter(F.col("product_id").isNotNull()).select(
            "seq", "product_id", "unit", "stored_unit", "scraped_at"
        ),
        keys=["product_id"],
        order=["seq"],
        values=["unit"],
        name="before",
        slice_rows=slice_rows,
    )
    old = F.when(F.col("before").isNull(), F.col("stored_unit")).otherwise(F.col("before.unit"))
    return (
        ordered.withColumn("old_unit", old)
        .filter(~missing(F.col("old_unit")) & ~missing(F.col("unit")))
        .filter(F.col("old_unit") != F.col("unit"))
        .select(
            F.col("seq").alias("id"),
            "product_id",
            "old_unit",
            F.col("unit").alias("new_unit"),
            F.col("scraped_at").alias("detected_at"),
        )
    )


def ingest_summary(resolved: DataFrame, new_prices: DataFrame) -> DataFrame:
    """Per store: observations saved, prices stored, prices rejected, errors; NULL store = total."""
    stored = new_prices.select(F.col("id").alias("seq"), F.lit(1).alias("_stored"))
    error = F.col("reason").isNotNull()
    rejected = price_reject_reason(F.col("price")).isNotNull()
    return (
        resolved.select("seq", "supermarket", "price", "reason")
        .join(stored, "seq", "left")
        .rollup("supermarket")
        .agg(
            F.count_if(~error).alias("scraped"),
            F.count("_stored").alias("inserted"),
            F.count_if(rejected & ~error).alias("rejected"),
            F.count_if(error).alias("errors"),
        )
    )


def require_observations(summary: Iterable[Row]) -> int:
    """Observations saved in all; fails a run without any, so that no empty data is published."""
    total = sum(row["scraped"] for row in summary if row["supermarket"] is None)
    if total == 0:
        raise RuntimeError("no product was observed in this run")
    return total


def day_stats(prices: DataFrame, day: Column | str) -> DataFrame:
    """Distinct products and price rows of one day."""
    start = F.lit(day).cast("date")
    return prices.filter(
        (F.col("scraped_at") >= start.cast("timestamp_ntz"))
        & (F.col("scraped_at") < F.date_add(start, 1).cast("timestamp_ntz"))
    ).agg(F.countDistinct("product_id").alias("products"), F.count("*").alias("prices"))
