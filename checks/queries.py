"""One query per operator, over the whole of the supplied tables."""

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import supplied as sup
from pricetrail.functions import parse_unit, slugify, strip_trailing_unit
from pricetrail.functions.units import parse_decimal, to_base_unit, unit_name
from pricetrail.operators import catalog, changes, ingest, matching, normalize, postings, publish
from pricetrail.plans.lineage import cut_lineage
from pricetrail.sources import pages as pg
from pricetrail.schemas import DERIVED_PRODUCT_COLUMNS
from pricetrail.sources.reference_data import category_map, category_paths

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

AS_OF = dt.date(2001, 11, 4)
DAYS = 673
GENERATED_AT = dt.datetime(2001, 11, 5)
ONE_PRODUCT = 304


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- sources --------------------------------------------------------------------------------


@query
def explode_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = pg.explode_cards(sup.table(spark, sf_dir, "pages"), None)
    return cards.select("page_id", "card_pos", F.md5("card").alias("card_md5"))


def _offers(spark: SparkSession, sf_dir: str, store: str) -> DataFrame:
    pages = sup.store_pages(spark, sf_dir).filter(F.col("supermarket") == store)
    return pg.EXTRACTORS[store](pg.explode_cards(pages, store)).select(
        "page_seq", "card_pos", "name", "brand", "unit", "link", "price", "original_price",
        "is_sale",
    )


@query
def extract_offers_ah(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir, "ah")


@query
def extract_offers_jumbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir, "jumbo")


@query
def extract_offers_dirk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir, "dirk")


@query
def attach_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pg.attach_category(sup.store_pages(spark, sf_dir), category_paths(spark))
    return pages.select("page_seq", "supermarket", "url", "category")


@query
def extract_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pg.attach_category(sup.store_pages(spark, sf_dir), category_paths(spark))
    return pg.extract_observations(pages)


@query
def seed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers per category of the seed map, by the real listing paths of their pages."""
    offers = extract_observations(spark, sf_dir).select("supermarket", "category")
    return catalog.canonical_categories(offers, category_map(spark))


@query
def unit_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sup.products(spark, sf_dir)
    return names.select("id", pg.unit_from_title(F.col("name")).alias("title_unit"))


@query
def infer_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sup.products(spark, sf_dir)
    by_store = F.when(F.col("supermarket") == "ah", pg.infer_brand(F.col("name"), "ah")).when(
        F.col("supermarket") == "jumbo", pg.infer_brand(F.col("name"), "jumbo")
    )
    return names.select("id", by_store.alias("house_brand"))


# ---- ingest ---------------------------------------------------------------------------------


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their true product, as if resolved before."""
    return sup.observations(spark, sf_dir).withColumnRenamed("known_id", "product_id")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = sup.observations(spark, sf_dir).drop("known_id")
    return ingest.resolve_products(batch, sup.stored_catalog(spark, sf_dir))


@query
def resolve_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("seq", "product_id", "stored_unit", "is_new", "reason")


@query
def resolve_new_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = sup.products(spark, sf_dir).filter(F.lit(False))
    batch = sup.observations(spark, sf_dir).drop("known_id")
    return ingest.resolve_products(batch, empty).select("seq", "product_id", "is_new", "reason")


@query
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = ingest.duplicate_names(_resolved(spark, sf_dir))
    return rejects.groupBy("name", "supermarket").agg(F.count("*").alias("rejected"))


@query
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sup.stored_catalog(spark, sf_dir)
    return ingest.upsert_products(_resolved(spark, sf_dir), stored).select(
        "id", "name", "brand", "category", "unit", "supermarket", "url", "created_at"
    )


@query
def rejected_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.rejected_prices(sup.raw_prices(spark, sf_dir))
    return rows.select("id", "product_id", "price", "reason")


@query
def first_price_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_price_per_day(sup.raw_prices(spark, sf_dir).withColumnRenamed("id", "seq"))


@query
def new_prices_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First prices of days that are not stored yet: returns come in, other rows are stored."""
    lines = sup.table(spark, sf_dir, "lineitem")
    stored = lines.filter("l_returnflag <> 'R'").selectExpr(
        "l_partkey * 3 + l_suppkey % 3 AS product_id", "l_shipdate AS scraped_at"
    )
    batch = sup.raw_prices(spark, sf_dir).withColumnRenamed("id", "seq")
    return ingest.first_price_per_day(batch, stored)


@query
def default_original_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.default_original_price(sup.raw_prices(spark, sf_dir))
    return rows.select("id", "price", "original_price", "is_sale")


@query
def clean_false_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.clean_false_sales(sup.raw_prices(spark, sf_dir))
    return rows.select("id", "original_price", "is_sale")


@query
def flag_price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.flag_price_jumps(sup.prices(spark, sf_dir))


@query
def add_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog from before normalization, and one that has the columns already."""
    full = sup.normalized_products(spark, sf_dir)
    old = ingest.add_missing_columns(full.drop(*DERIVED_PRODUCT_COLUMNS)).withColumn("old", F.lit(1))
    new = ingest.add_missing_columns(full).withColumn("old", F.lit(0))
    return old.unionByName(new).select("id", "old", "name", *DERIVED_PRODUCT_COLUMNS)


@query
def flag_event_price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on prices with many rows per product and day."""
    return ingest.flag_price_jumps(sup.event_prices(spark, sf_dir))


@query
def detect_unit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_unit_changes(_known(spark, sf_dir))


@query
def detect_stored_unit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit changes of a resolved batch, the first ones against the stored catalog."""
    return ingest.detect_unit_changes(_resolved(spark, sf_dir))


@query
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved(spark, sf_dir)
    return ingest.ingest_summary(resolved, ingest.first_price_per_day(resolved))


@query
def day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.day_stats(sup.prices(spark, sf_dir), "2001-06-01")


# ---- column functions and normalization -----------------------------------------------------


@query
def parse_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sup.products(spark, sf_dir).select("id", parse_unit(F.col("unit")).alias("size"))
    return rows.select("id", F.col("size.qty").alias("qty"), F.col("size.type").alias("type"))


@query
def unit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and unit word of simple sizes, step by step."""
    number = parse_decimal(F.regexp_extract("unit", r"^([\d.,]+)", 1))
    unit = unit_name(F.regexp_extract("unit", r"([A-Za-z]+)$", 1))
    base = to_base_unit(number, unit)
    return sup.products(spark, sf_dir).select(
        "id", number.alias("number"), unit.alias("unit_name"), base["qty"].alias("base_qty"),
        base["type"].alias("base_type"),
    )


@query
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = normalize.normalize_names(sup.products(spark, sf_dir))
    return named.select(
        "id",
        "normalized_name",
        strip_trailing_unit(F.col("normalized_name")).alias("match_key"),
        slugify(F.col("name")).alias("slug"),
    )


@query
def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = normalize.normalize_units(sup.products(spark, sf_dir), sup.prices(spark, sf_dir))
    return sized.select("id", "unit_quantity", "unit_type", "price_per_unit")


@query
def normalization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalization_stats(normalize.with_pack_size(sup.products(spark, sf_dir)))


@query
def canonical_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.with_canonical_category(
        sup.products(spark, sf_dir), sup.category_map(spark, sf_dir)
    )
    return rows.select("id", "canonical_category")


# ---- lookup, search and comparison ----------------------------------------------------------


@query
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_price(sup.prices(spark, sf_dir))


@query
def latest_event_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.latest_price(sup.event_prices(spark, sf_dir))
    return rows.select("product_id", "price", "scraped_at")


@query
def refresh_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest prices put together from an older result and the prices after it."""
    prices = sup.prices(spark, sf_dir)
    turn = F.lit("2000-01-01").cast("timestamp_ntz")
    stored = catalog.latest_price(prices.filter(F.col("scraped_at") < turn))
    return catalog.refresh_latest(stored, prices.filter(F.col("scraped_at") >= turn))


@query
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(
        sup.normalized_products(spark, sf_dir), sup.prices(spark, sf_dir), "bOlT b_AND"
    ).select("id", "name", "supermarket", "normalized_name", "latest_price", "is_sale", "scraped_at")


@query
def search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir), "gear", 30, "jumbo"
    ).select("id", "name", "supermarket", "latest_price", "original_price")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.compare(
        sup.normalized_products(spark, sf_dir), sup.prices(spark, sf_dir), "widget"
    )


@query
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select(
        "group_name", "multi_store", "id", "supermarket", "latest_price", "unit_type",
        "price_per_unit", "is_sale",
    )


def _postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Catalog, prices, and the stored postings of all names with their sizes."""
    # Read for the postings, and again with the hits for each part of an answer.
    products = cut_lineage(sup.normalized_products(spark, sf_dir))
    lists = cut_lineage(postings.by_gram(postings.name_postings(products)))
    return products, sup.prices(spark, sf_dir), lists, postings.gram_sizes(lists)


@query
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(*_postings(spark, sf_dir), "bOlT b_AND").select(
        "id", "name", "supermarket", "normalized_name", "latest_price", "is_sale", "scraped_at"
    )


@query
def compare_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.compare(*_postings(spark, sf_dir), "widget").select(
        "group_name", "multi_store", "id", "supermarket", "latest_price", "unit_type",
        "price_per_unit", "is_sale",
    )


@query
def posting_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)[3]


@query
def rank_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rank_offers(_compared(spark, sf_dir)).select(
        "group_name", "id", "supermarket", "latest_price", "is_cheapest", "diff_pct"
    )


@query
def single_store_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.single_store_offers(_compared(spark, sf_dir))


@query
def product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.product_history(sup.prices(spark, sf_dir)).drop("scraped_at")


@query
def one_product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of one product, the feature of the operator."""
    return catalog.product_history(sup.prices(spark, sf_dir), product_id=ONE_PRODUCT)


@query
def products_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.all_products_with_history(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir)
    )
    flat = rows.select(
        "id", "supermarket", "name", "part", F.posexplode_outer("price_history").alias("pos", "e")
    )
    return flat.select(
        "id", "supermarket", "name", "part", "pos", F.col("e.price").alias("price"),
        F.col("e.scraped_at").alias("scraped_at"), F.col("e.is_sale").alias("is_sale"),
    )


@query
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.store_counts(normalize.with_pack_size(sup.products(spark, sf_dir)))


@query
def price_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.price_totals(sup.prices(spark, sf_dir))


@query
def category_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.category_total(sup.products(spark, sf_dir))


@query
def product_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.product_total(sup.products(spark, sf_dir))


@query
def canonical_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.canonical_categories(
        sup.products(spark, sf_dir), sup.category_map(spark, sf_dir)
    )


@query
def published_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is mapped, so the earlier result comes back."""
    products, mapped = sup.products(spark, sf_dir), sup.category_map(spark, sf_dir)
    published = catalog.canonical_categories(products, mapped)
    return catalog.canonical_categories(products, mapped.filter(F.lit(False)), published)


@query
def products_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.products_in_category(
        sup.normalized_products(spark, sf_dir),
        sup.prices(spark, sf_dir),
        sup.category_map(spark, sf_dir),
        "regular",
    ).select("id", "canonical_category", "normalized_name", "latest_price", "price_per_unit")


@query
def category_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = catalog.category_products(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir), sup.category_map(spark, sf_dir)
    )
    return catalog.category_page(priced).select(
        "canonical_category", "position", "id", "latest_price", "category_size"
    )


@query
def in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category text and canonical category at once: "bulk" is mapped, "promo" is only a text."""
    products, mapped = sup.products(spark, sf_dir), sup.category_map(spark, sf_dir)
    found = [
        catalog.in_category(products, mapped, name).select("id", F.lit(name).alias("asked"))
        for name in ("bulk", "PROMO", "budget")
    ]
    return reduce(DataFrame.unionByName, found)


# ---- price changes --------------------------------------------------------------------------


@query
def first_last_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.first_last_prices(sup.prices(spark, sf_dir), DAYS, AS_OF)


@query
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, prices = sup.normalized_products(spark, sf_dir), sup.prices(spark, sf_dir)
    return changes.price_changes(products, prices, DAYS, AS_OF)


@query
def price_changes_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.price_changes(
        sup.products(spark, sf_dir),
        sup.prices(spark, sf_dir),
        DAYS,
        AS_OF,
        category="bulk",
        supermarket="ah",
        min_change=25.0,
        category_map=sup.category_map(spark, sf_dir),
    ).select("id", "first_price", "latest_price", "pct_change", "abs_change")


@query
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.top_movers(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir), DAYS, AS_OF
    ).select("direction", "position", "id", "first_price", "latest_price", "pct_change")


@query
def inflation_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.inflation_by_category(
        sup.products(spark, sf_dir),
        sup.prices(spark, sf_dir),
        sup.category_map(spark, sf_dir),
        DAYS,
        AS_OF,
    )


@query
def inflation_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.inflation_by_store(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir), DAYS, AS_OF
    )


@query
def fake_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fake_sales(sup.products(spark, sf_dir), sup.prices(spark, sf_dir))


@query
def shrinkflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit_changes = ingest.detect_unit_changes(_known(spark, sf_dir))
    return changes.shrinkflation(sup.products(spark, sf_dir), unit_changes)


@query
def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.price_index(sup.products(spark, sf_dir), sup.prices(spark, sf_dir))


@query
def price_index_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.price_index_wide(price_index(spark, sf_dir))


# ---- matching -------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_candidates(normalize.normalize_names(
        normalize.with_pack_size(sup.products(spark, sf_dir))))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for the exact matches and twice for the pool; the texts of the products are parsed once.
    candidates = cut_lineage(_candidates(spark, sf_dir))
    exact = cut_lineage(matching.match_exact(candidates))
    return cut_lineage(matching.fuzzy_pool(candidates, exact, sup.category_map(spark, sf_dir)))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    products = normalize.normalize_names(normalize.with_pack_size(sup.products(spark, sf_dir)))
    return matching.build_match_groups(products, sup.category_map(spark, sf_dir))


@query
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates once the exact matches are members already."""
    products = normalize.normalize_names(normalize.with_pack_size(sup.products(spark, sf_dir)))
    members = matching.match_exact(matching.match_candidates(products))
    return matching.match_candidates(products, members).select("id", "match_key", "store_rank")


@query
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_exact(_candidates(spark, sf_dir))


@query
def fuzzy_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("block", "store_rank", "match_key", "product_id", "unit_type")


@query
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    pairs = matching.similar_pairs(pool.filter("store_rank = 1"), pool.filter("store_rank > 1"))
    return pairs.select("base_id", "other_id", "distance").distinct()


@query
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    fuzzy = matching.match_fuzzy(_pool(spark, sf_dir))
    return fuzzy.select("match_id", "product_id", "match_key", "distance")


@query
def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[0]


@query
def match_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1]


@query
def unconfirmed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, members = _groups(spark, sf_dir)
    return matching.unconfirmed_matches(
        matches,
        members,
        sup.products(spark, sf_dir),
        sup.prices(spark, sf_dir),
        limit=100,
        category="budget",
        category_map=sup.category_map(spark, sf_dir),
    ).select("match_id", "canonical_name", "confidence", "product_id", "supermarket", "latest_price")


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    matches, members = _groups(spark, sf_dir)
    decisions = matches.filter(F.col("confirmed") == 0).select(
        F.col("id").alias("match_id"), (F.col("confidence") > 0.85).alias("confirmed")
    )
    return matching.apply_review(matches, members, decisions)


@query
def apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, members = _reviewed(spark, sf_dir)
    sizes = members.groupBy(F.col("match_id").alias("id")).agg(F.count("*").alias("members"))
    return matches.join(sizes, "id").select("id", "match_type", "confirmed", "members")


@query
def matched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched_groups(
        *_groups(spark, sf_dir), sup.normalized_products(spark, sf_dir), sup.prices(spark, sf_dir)
    ).select("match_id", "canonical_name", "product_id", "latest_price", "price_per_unit")


@query
def plausible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.plausible_groups(
        *_reviewed(spark, sf_dir), sup.products(spark, sf_dir), sup.prices(spark, sf_dir)
    ).select("match_id", "canonical_name", "product_id", "latest_price")


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.comparison_table(
        *_reviewed(spark, sf_dir),
        sup.normalized_products(spark, sf_dir),
        sup.prices(spark, sf_dir),
    )


@query
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparison(spark, sf_dir).select(
        "match_id", "slug", "product_id", "seller", "price", "is_cheapest", "cheapest_store",
        "diff_pct",
    )


# ---- published datasets ---------------------------------------------------------------------


@query
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publish.export_history(sup.products(spark, sf_dir), sup.prices(spark, sf_dir))
    flat = rows.select("id", "url", F.posexplode_outer("price_history").alias("pos", "e"))
    return flat.select("id", "url", "pos", "e.price", "e.original_price", "e.is_sale", "e.date")


@query
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.export_rows(sup.products(spark, sf_dir), sup.prices(spark, sf_dir))


@query
def category_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.category_datasets(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir), sup.category_map(spark, sf_dir)
    ).select("category_slug", "id", "latest_price", "is_sale")


@query
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.search_index(
        sup.normalized_products(spark, sf_dir), sup.prices(spark, sf_dir)
    )


@query
def history_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publish.history_extract(sup.prices(spark, sf_dir))
    flat = rows.select("product_id", F.posexplode("price_history").alias("pos", "e"))
    return flat.select("product_id", "pos", "e.price", "e.is_sale", "e.date")


@query
def build_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.build_meta(
        sup.products(spark, sf_dir), sup.prices(spark, sf_dir), GENERATED_AT
    )


@query
def site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.site_urls(canonical_categories(spark, sf_dir), _comparison(spark, sf_dir))
