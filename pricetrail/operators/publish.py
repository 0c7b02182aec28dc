"""Published datasets: frames ready to write, and their writers."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions import slugify
from pricetrail.operators.catalog import (
    all_products_with_history,
    category_products,
    price_series,
    price_totals,
    product_total,
    with_latest_price,
)
from pricetrail.plans.joins import join_large

# Pages that always exist, priorities by kind of page, sale words of the CSV file.
FIXED_PAGES = ("", "categorieen", "over", "privacy")
PRIORITIES = {"page": 1.0, "category": 0.8, "comparison": 0.7}
SALE_WORDS = ("ja", "nee")


def export_history(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products with their price history as nested records, for the JSON export."""
    history = F.transform(
        "price_history",
        lambda entry: F.struct(
            entry["price"].alias("price"),
            entry["original_price"].alias("original_price"),
            (F.coalesce(entry["is_sale"], F.lit(0)) != 0).alias("is_sale"),
            entry["scraped_at"].alias("date"),
        ),
    )
    return all_products_with_history(products, prices).select(
        "id", "name", "brand", "category", "unit", "supermarket", "url", "created_at", "part",
        history.alias("price_history"),
    )


def export_rows(products: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per product and price, for the CSV export."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    info = products.select(
        F.col("id").alias("product_id"), "name", text("brand"), text("category"), text("unit"),
        "supermarket", text("url"),
    )
    yes, no = SALE_WORDS
    return join_large(prices, info, "product_id").select(
        "product_id", "name", "brand", "category", "unit", "supermarket", "url", "price",
        "original_price", F.when(F.col("is_sale") != 0, yes).otherwise(no).alias("is_sale"),
        F.col("scraped_at").alias("date"),
    )


def category_datasets(products: DataFrame, prices: DataFrame, category_map: DataFrame) -> DataFrame:
    """Products of every canonical category, with the slug that names the category's files."""
    rows = category_products(products, prices, category_map)
    return rows.withColumn("category_slug", slugify(F.col("canonical_category")))


def search_index(products: DataFrame, prices: DataFrame) -> DataFrame:
    """All products with newest price under short keys; `supermarket` splits the files."""
    return with_latest_price(products, prices, "price").select(
        "supermarket",
        F.col("id").alias("i"),
        F.col("name").alias("n"),
        F.col("supermarket").alias("s"),
        F.col("category").alias("c"),
        F.col("unit").alias("u"),
        F.col("unit_type").alias("ut"),
        F.col("unit_quantity").alias("uq"),
        F.col("price_per_unit").alias("pp"),
        F.col("normalized_name").alias("nn"),
        F.col("price").alias("p"),
        F.col("original_price").alias("op"),
        F.col("is_sale").alias("sa"),
    )


def history_extract(prices: DataFrame) -> DataFrame:
    """Price series of the products with more than one price."""
    series = F.transform(
        "price_history",
        lambda entry: F.struct(
            entry["price"].alias("price"),
            entry["original_price"].alias("original_price"),
            entry["is_sale"].alias("is_sale"),
            F.to_date(entry["scraped_at"]).alias("date"),
        ),
    )
    return price_series(prices, min_entries=2).select(
        "product_id", "part", series.alias("price_history")
    )


def build_meta(
    products: DataFrame, prices: DataFrame, generated_at: dt.datetime | None = None
) -> DataFrame:
    """One row: time of the build, number of products and prices, days covered."""
    moment = F.current_timestamp() if generated_at is None else F.lit(generated_at)
    return price_totals(prices).select(
        moment.cast("timestamp_ntz").alias("generated_at"),
        product_total(products).scalar().alias("product_count"),
        F.col("total_prices").alias("price_count"),
        "first_date",
        "last_date",
        "days",
    )


def site_urls(categories: DataFrame, comparison: DataFrame) -> DataFrame:
    """Pages of the site: kind, slug, priority, and how many pages share the slug."""
    spark = categories.sparkSession
    fixed = spark.createDataFrame([(name,) for name in FIXED_PAGES], "slug string")

    def pages(frame: DataFrame, kind: str, slug: Column) -> DataFrame:
        return frame.select(
            F.lit(kind).alias("kind"), slug.alias("slug"), F.lit(PRIORITIES[kind]).alias("priority")
        )

    urls = (
        pages(fixed, "page", F.col("slug"))
        .unionByName(pages(categories, "category", slugify(F.col("canonical_category"))))
        .unionByName(pages(comparison.filter("is_cheapest"), "comparison", F.col("slug")))
    )
    # Equal slugs are counted before they meet, so a much used slug stays one row.
    return urls.groupBy("kind", "slug", "priority").agg(F.count("*").alias("pages"))


# ---- writers --------------------------------------------------------------------------------


def write_json(
    df: DataFrame, path: str, split_by: str | None = None, order: tuple[str, ...] = (),
    max_rows: int = 0,
) -> None:
    """Write JSON lines, one folder per value of `split_by`, files of at most `max_rows` rows.

    `order` sorts globally before writing: rows are spread by range, so neither a large store nor
    a large category ends up in one task.
    """
    if order:
        df = df.orderBy(*order)
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if split_by:
        writer = writer.partitionBy(split_by)
    writer.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header; values with commas, quotes or line breaks are quoted."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)
