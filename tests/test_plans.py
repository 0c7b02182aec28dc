"""The physical plans the operators are meant to get."""

import datetime as dt
import re

import pytest

from checks import supplied as sup
from checks.queries import QUERIES
from pricetrail.operators import catalog, changes, ingest, matching, normalize
from pricetrail.plans.lineage import cut_lineage

SF_DIR = "/root/testdata/sf0.001"
AS_OF = dt.date(2001, 11, 4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    sup.prices(spark, SF_DIR).write.parquet(f"{folder}/prices")
    sup.normalized_products(spark, SF_DIR).write.parquet(f"{folder}/products")
    return spark.read.parquet(f"{folder}/products"), spark.read.parquet(f"{folder}/prices")


def test_latest_price_combines_before_the_shuffle(stored):
    text = plan(catalog.latest_price(stored[1]))
    assert text.count("Exchange") == 1 and "partial_max" in text and "Window" not in text


def test_first_and_newest_rows_are_hash_aggregates(stored):
    prices = stored[1]
    observed = prices.withColumnRenamed("id", "seq")
    for df in (
        catalog.latest_price(prices),
        changes.first_last_prices(prices, 673, AS_OF),
        ingest.first_price_per_day(observed),
    ):
        text = plan(df)
        assert "HashAggregate" in text and "SortAggregate" not in text
        assert "ObjectHashAggregate" not in text


def test_look_back_reaches_the_scan_and_both_ends_share_it(stored):
    text = plan(changes.first_last_prices(stored[1], 673, AS_OF))
    assert "GreaterThanOrEqual(scraped_at,2000-01-01" in text
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "is_sale" not in text.split("ReadSchema")[1]


def test_valid_prices_are_filtered_in_the_scan(stored):
    text = plan(ingest.valid_prices(stored[1]))
    assert "GreaterThan(price,0.0)" in text and "LessThanOrEqual(price,500.0)" in text


def test_search_reads_prices_of_its_hits_only(stored):
    text = plan(catalog.search(*stored, "melk", 30))
    assert "TakeOrderedAndProject(limit=30" in text
    assert "LeftSemi, BuildRight" in text


def test_top_lists_are_cut_before_the_shuffle(spark, stored):
    products, prices = stored
    pages = catalog.category_products(products, prices, sup.category_map(spark, SF_DIR))
    for df in (
        catalog.category_page(pages),
        changes.top_movers(products, prices, 673, AS_OF),
    ):
        assert "WindowGroupLimit" in plan(df) and "Partial" in plan(df)


def test_names_are_matched_by_equi_join(spark):
    pool = spark.createDataFrame(
        [("b", 1, "melk", 1, None, ("melk", 1)), ("b", 2, "melks", 2, None, ("melks", 2))],
        "block string, store_rank int, match_key string, product_id long, unit_type string, "
        "place struct<normalized_name: string, id: long>",
    )
    text = plan(matching.match_fuzzy(pool))
    assert re.search(r"(HashJoin|SortMergeJoin) \[[^]]*signature", text)


def test_pieces_of_names_are_not_broadcast(spark, tmp_path):
    """A small file of names has many pieces: they meet by shuffle, whatever the file's size is."""
    rows = [("b", 1 + k % 3, f"melk {k}", k, None, ("melk", k)) for k in range(50)]
    schema = ("block string, store_rank int, match_key string, product_id long, unit_type string, "
              "place struct<normalized_name: string, id: long>")  # fmt: skip
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pool")
    text = plan(matching.match_fuzzy(spark.read.parquet(f"{tmp_path}/pool")))
    assert re.search(r"SortMergeJoin \[[^]]*signature", text)


def test_numbers_of_sizes_are_read_once(spark):
    products = spark.createDataFrame([(1, "1,5 l")], "id int, unit string")
    text = normalize.with_pack_size(products)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") == 1


def test_parsing_is_written_in_compiled_methods(spark, monkeypatch):
    """The parsing of a product is more than one method that the JVM compiles; the setting comes back."""
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    writer = type(spark.range(1).write)
    written = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda *a: seen.append(spark.conf.get(name)) or written(*a))
    try:
        assert cut_lineage(spark.range(3)).count() == 3
        assert seen == ["8000"] and spark.conf.get(name) == "65535"
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["similar_pairs", "match_groups"])
def test_texts_of_products_are_parsed_once_for_matching(spark, name, monkeypatch):
    plans, first = [], matching.first_per_key

    def noted(candidates):
        plans.append(candidates._jdf.queryExecution().optimizedPlan().toString())
        return first(candidates)

    monkeypatch.setattr(matching, "first_per_key", noted)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3
    assert not any("regexp_replace" in plan for plan in plans)
