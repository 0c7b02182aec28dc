"""Lookup, search and comparison over the catalog and its newest prices."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions import contains_term, missing, moment_key, round_half, round_up_half
from pricetrail.plans.joins import join_small

PRICE_FIELDS = ("price", "original_price", "is_sale", "scraped_at")
PRODUCT_FIELDS = (
    "id", "name", "brand", "category", "unit", "supermarket", "url", "normalized_name",
    "unit_quantity", "unit_type", "price_per_unit",
)
ITEM_FIELDS = (
    "id", "name", "supermarket", "category", "unit", "unit_type", "unit_quantity",
    "price_per_unit", "normalized_name",
)


def latest_price(prices: DataFrame) -> DataFrame:
    """Newest price row of every product; equal times are decided by the higher id.

    `prices` is the history, or a table of newest prices, which has no `id`: it is taken as it is.
    A maximum combines on the map side, so a product's history never meets in one task; keys and
    values of fixed width keep it a hash aggregate, without sorting the history.
    """
    if "id" not in prices.columns:
        return prices.select("product_id", *PRICE_FIELDS)
    key = moment_key(F.col("scraped_at"), F.col("id"))
    return prices.groupBy("product_id").agg(
        *(F.max_by(field, key).alias(field) for field in PRICE_FIELDS)
    )


def refresh_latest(latest: DataFrame, new_prices: DataFrame) -> DataFrame:
    """Newest price per product from an earlier result and the rows added since.

    Lets a daily run read one day instead of the whole history.
    """
    columns = ["product_id", *PRICE_FIELDS]
    stored = latest.select(*columns, F.lit(-1).cast("long").alias("id"))
    return latest_price(stored.unionByName(new_prices.select(*columns, "id")))


def with_latest_price(
    products: DataFrame, prices: DataFrame, price_name: str = "latest_price"
) -> DataFrame:
    """Left join of every product with its newest price."""
    newest = latest_price(prices).withColumnRenamed("price", price_name)
    return products.join(newest.withColumnRenamed("product_id", "id"), "id", "left")


def with_canonical_category(
    products: DataFrame, category_map: DataFrame, name: str = "canonical_category"
) -> DataFrame:
    """Add the mapped category, or the store's own category when it is not mapped."""
    lookup = category_map.select(
        F.col("canonical_category").alias("_mapped"),
        "supermarket",
        F.col("original_category").alias("category"),
    )
    joined = join_small(products, lookup, ["supermarket", "category"], "left")
    return joined.withColumn(name, F.coalesce("_mapped", "category")).drop("_mapped")


def in_category(products: DataFrame, category_map: DataFrame, category: str) -> DataFrame:
    """Products whose own category contains the text, or that are mapped to that category."""
    mapped = category_map.filter(F.col("canonical_category") == category).select(
        "supermarket", F.col("original_category").alias("category"), F.lit(True).alias("_mapped")
    )
    joined = join_small(products, mapped, ["supermarket", "category"], "left")
    fits = contains_term(F.col("category"), category) | F.col("_mapped")
    return joined.filter(fits).drop("_mapped")


def search(
    products: DataFrame,
    prices: DataFrame,
    term: str,
    limit: int = 50,
    supermarket: str | None = None,
) -> DataFrame:
    """First `limit` products (by store, name) whose name contains the term, with newest price.

    The hits are cut to `limit` before prices are read, so the price history is filtered by a
    handful of broadcast ids instead of being aggregated as a whole.
    """
    hits = products.filter(contains_term(F.col("name"), term))
    if supermarket is not None:
        hits = hits.filter(F.col("supermarket") == supermarket)
    hits = hits.select(*PRODUCT_FIELDS).orderBy("supermarket", "name", "id").limit(limit)
    return _with_prices_of_few(hits, prices).orderBy("supermarket", "name", "id")


def _with_prices_of_few(few: DataFrame, prices: DataFrame) -> DataFrame:
    """Newest prices for a frame cut by LIMIT; its ids go to the price scan by broadcast."""
    ids = F.broadcast(few.select(F.col("id").alias("product_id")))
    return with_latest_price(few, prices.join(ids, "product_id", "left_semi"))


def compare(products: DataFrame, prices: DataFrame, term: str) -> DataFrame:
    """Products that contain the term, by comparison group, with newest price.

    One row per item: `group_name`, `multi_store` (sold by more than one store), the item.
    """
    fits = contains_term(F.col("name"), term) | F.coalesce(
        contains_term(F.col("normalized_name"), term), F.lit(False)
    )
    hits = products.filter(fits).select(
        F.when(missing(F.col("normalized_name")), F.lower("name"))
        .otherwise(F.col("normalized_name"))
        .alias("group_name"),
        *ITEM_FIELDS,
    )
    several = hits.groupBy("group_name").agg(
        (F.min("supermarket") != F.max("supermarket")).alias("multi_store")
    )
    ids = hits.select(F.col("id").alias("product_id"))
    priced = with_latest_price(hits, prices.join(ids, "product_id", "left_semi"))
    return priced.join(several, "group_name").drop("scraped_at")


def rank_offers(items: DataFrame, max_groups: int = 15) -> DataFrame:
    """Offers of the first `max_groups` multi-store groups: cheapest mark and surplus in percent."""
    names = (
        items.filter("multi_store").select("group_name").distinct()
        .orderBy("group_name").limit(max_groups)
    )
    priced = items.filter(F.col("latest_price").isNotNull()).join(F.broadcast(names), "group_name")
    # Cut by LIMIT above: at most max_groups rows.
    cheapest = priced.groupBy("group_name").agg(
        F.min(F.struct("latest_price", "supermarket", "id")).alias("best")
    )
    surplus = (F.col("latest_price") - F.col("best.latest_price")) / F.col("best.latest_price")
    is_best = F.col("id") == F.col("best.id")
    return (
        priced.join(F.broadcast(cheapest), "group_name")
        .select(
            "group_name",
            *ITEM_FIELDS,
            "latest_price",
            "is_sale",
            is_best.alias("is_cheapest"),
            F.when(~is_best & (F.col("best.latest_price") != 0), round_up_half(surplus * 100))
            .alias("diff_pct"),
        )
        .orderBy("group_name", "latest_price", "supermarket", "id")
    )


def single_store_offers(items: DataFrame, max_groups: int = 10) -> DataFrame:
    """First item of the first `max_groups` groups that only one store sells."""
    columns = ["supermarket", "id", "name", "latest_price"]
    return (
        items.filter(~F.col("multi_store"))
        .groupBy("group_name")
        .agg(F.min(F.struct(*columns)).alias("first"))
        .orderBy("group_name")
        .limit(max_groups)
        .select("group_name", *(f"first.{name}" for name in columns))
    )


def product_history(
    prices: DataFrame, product_id: int | None = None, products: DataFrame | None = None
) -> DataFrame:
    """Price series with its days, of one product, of a set of products, or of all."""
    if product_id is not None:
        prices = prices.filter(F.col("product_id") == product_id)
    if products is not None:
        ids = products.select(F.col("id").alias("product_id"))
        prices = prices.join(ids, "product_id", "left_semi")
    return prices.select(
        "product_id", "price", "original_price", "is_sale",
        F.to_date("scraped_at").alias("date"), "scraped_at", "id",
    ).orderBy("product_id", "scraped_at", "id")


def product_with_history(products: DataFrame, prices: DataFrame, product_id: int) -> DataFrame:
    """One product with its price series; no row when the product is unknown."""
    product = products.filter(F.col("id") == product_id)
    return all_products_with_history(product, prices.filter(F.col("product_id") == product_id))


def price_series(prices: DataFrame, min_entries: int = 1) -> DataFrame:
    """Ordered price array per product and year (`part`) of products with `min_entries` or more.

    The form is the same at any size. Stored prices hold one entry per product and day, so that
    an array never has more than 366.
    """
    entry = F.struct("scraped_at", "id", "price", "original_price", "is_sale")
    series = prices.groupBy("product_id", F.year("scraped_at").alias("part")).agg(
        F.sort_array(F.collect_list(entry)).alias("price_history")
    )
    if min_entries > 1:
        # Over a product's years, one row each.
        entries = F.sum(F.size("price_history")).over(Window.partitionBy("product_id"))
        series = series.withColumn("_entries", entries).filter(F.col("_entries") >= min_entries)
    return series.select("product_id", "part", "price_history")


def all_products_with_history(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Every product with its price arrays by year; one empty array, without year, if none."""
    series = price_series(prices).withColumnRenamed("product_id", "id")
    return products.join(series, "id", "left").withColumn(
        "price_history", F.coalesce("price_history", F.array())
    )


def store_counts(products: DataFrame) -> DataFrame:
    """Products and products with a known unit per store; NULL store is the total."""
    return (
        products.rollup("supermarket")
        .agg(F.count("*").alias("products"), F.count("unit_type").alias("with_units"))
        .orderBy(F.desc("products"), "supermarket")
    )


def price_totals(prices: DataFrame) -> DataFrame:
    """Number of prices, first and last day, number of days."""
    # Counting per day first keeps the exact count of days cheap at any number of rows.
    days = prices.groupBy(F.to_date("scraped_at").alias("day")).agg(F.count("*").alias("n"))
    return days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_prices"),
        F.min("day").alias("first_date"),
        F.max("day").alias("last_date"),
        F.count("day").alias("days"),
    )


def category_total(products: DataFrame) -> DataFrame:
    """Number of distinct store categories."""
    return products.agg(F.countDistinct("category").alias("categories"))


def product_total(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("product_count"))


def canonical_categories(
    products: DataFrame, category_map: DataFrame, published: DataFrame | None = None
) -> DataFrame:
    """Products per canonical category, largest first.

    With `published` (an earlier result) that result is returned when nothing is mapped.
    """
    lookup = category_map.select(
        "canonical_category", "supermarket", F.col("original_category").alias("category")
    )
    counts = (
        join_small(products.select("supermarket", "category"), lookup,
                   ["supermarket", "category"], "inner")
        .groupBy("canonical_category")
        .agg(F.count("*").alias("product_count"))
    )
    if published is not None:
        counts = counts.unionByName(published.select(*counts.columns).where(~counts.exists()))
    return counts.orderBy(F.desc("product_count"), "canonical_category")


def category_products(products: DataFrame, prices: DataFrame, category_map: DataFrame) -> DataFrame:
    """Products of all canonical categories with newest price."""
    lookup = category_map.select(
        "canonical_category", "supermarket", F.col("original_category").alias("category")
    )
    mapped = join_small(
        products.select(*ITEM_FIELDS), lookup, ["supermarket", "category"], "inner"
    )
    return with_latest_price(mapped, prices).drop("scraped_at")


def products_in_category(
    products: DataFrame, prices: DataFrame, category_map: DataFrame, category: str
) -> DataFrame:
    """Products of one canonical category with newest price, by normalized name."""
    one = category_map.filter(F.col("canonical_category") == category)
    return category_products(products, prices, one).orderBy("normalized_name", "id")


def category_page(priced: DataFrame, top: int = 200) -> DataFrame:
    """The `top` cheapest products of each category (unpriced first) and the category's size.

    Takes the result of category_products. Spark cuts each map partition to `top` rows per
    category before the shuffle; the size comes from a separate aggregate so that it can.
    """
    cheapest = Window.partitionBy("canonical_category").orderBy("latest_price", "id")
    sizes = priced.groupBy("canonical_category").agg(F.count("*").alias("category_size"))
    return (
        priced.withColumn("position", F.row_number().over(cheapest))
        .filter(F.col("position") <= top)
        .join(sizes, "canonical_category")
    )


def percent(part: Column, whole: Column, digits: int) -> Column:
    return round_half(part.cast("double") / whole * 100.0, digits)
