"""Batch normalization of the catalog: pack sizes, unit prices and names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.functions import clean_text, normalize_name, price_per_unit, units
from pricetrail.operators.catalog import latest_price


def with_pack_size(products: DataFrame) -> DataFrame:
    """Set unit_quantity and unit_type from the unit text, NULL when it is not measurable."""
    # Successive projections, so that each step is computed once per row.
    staged = products.withColumn("_clean", clean_text(F.col("unit")))
    staged = staged.withColumn("_text", units.without_notes(F.col("_clean"))).drop("_clean")
    text, parts, number, unit = map(F.col, ("_text", "_parts", "_number", "_unit"))
    staged = staged.withColumn("_parts", units.size_parts(text))
    staged = staged.withColumns(
        {
            "_number": units.parse_decimal(units.part(parts, 2)),
            "_unit": units.unit_name(units.part(parts, 3)),
            "_piece": units.is_piece(text),
        }
    )
    staged = staged.withColumn("_measured", units.is_measured(text, parts, number, unit))
    quantity = F.when(F.col("_piece"), 1.0).when(
        F.col("_measured"), units.pack_quantity(parts, number, unit)
    )
    kind = F.when(F.col("_piece"), "stuk").when(F.col("_measured"), units.base_kind(unit))
    return (
        staged.withColumns({"unit_quantity": quantity, "unit_type": kind})
        .drop("_text", "_parts", "_number", "_unit", "_piece", "_measured")
    )


def normalize_units(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Pack size of every product and the unit price at its newest price."""
    return normalize_units_at(products, latest_price(prices))


def normalize_units_at(products: DataFrame, latest: DataFrame) -> DataFrame:
    """The same, from a stored table of newest prices."""
    newest = latest.select(F.col("product_id").alias("id"), F.col("price").alias("_latest"))
    unit_price = price_per_unit(F.col("_latest"), F.col("unit_quantity"), F.col("unit_type"))
    return (
        with_pack_size(products)
        .join(newest, "id", "left")
        .withColumn("price_per_unit", unit_price)
        .drop("_latest")
    )


def normalize_names(products: DataFrame) -> DataFrame:
    return products.withColumn("normalized_name", normalize_name(F.col("name")))


def normalize(products: DataFrame, prices: DataFrame) -> DataFrame:
    return normalize_names(normalize_units(products, prices))


def normalization_stats(products: DataFrame) -> DataFrame:
    """How many unit texts could be parsed."""
    return products.agg(
        F.count("unit_type").alias("parsed"),
        F.count_if(F.col("unit_type").isNull()).alias("skipped"),
        F.count("*").alias("total"),
    )
