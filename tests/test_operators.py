import datetime as dt

import pytest
from helpers import day, mapping, prices, products
from pyspark.sql import functions as F

from pricetrail.operators import catalog, changes, ingest, normalize, publish
from pricetrail.schemas import OBSERVATIONS
from pricetrail.sources.reference_data import first_mapping

AS_OF = dt.date(2026, 3, 31)


def shop(number, store, name, category="c", **other):
    return dict(id=number, supermarket=store, name=name, category=category, **other)


@pytest.fixture(scope="module")
def goods(spark):
    return products(spark, [
        shop(1, "ah", "AH Melk", "zuivel", normalized_name="melk"),
        shop(2, "jumbo", "Jumbo Melk", "melk", normalized_name="melk"),
        shop(3, "dirk", "Volle MELK", "overig"),
        shop(4, "ah", "Kaas", None, normalized_name="kaas"),
        shop(5, "ah", "Nooit geprijsd melk", "zuivel", normalized_name=""),
    ])


@pytest.fixture(scope="module")
def history(spark):
    return prices(spark, [
        (1, 1, 1.0, day(1)), (2, 1, 1.2, day(5)), (3, 1, 1.5, day(9)),
        (4, 2, 2.0, day(1)), (5, 2, 1.0, day(9)), (6, 2, 1.1, day(9)),
        (7, 3, 3.0, day(2)), (8, 3, 3.0, day(9)),
        (9, 4, 4.0, day(4)),
    ])


@pytest.fixture(scope="module")
def mapped(spark):
    return mapping(spark, [("zuivel & eieren", "ah", "zuivel"), ("zuivel & eieren", "jumbo", "melk")])


def test_latest_price_breaks_ties_by_id(history):
    got = {r.product_id: r.price for r in catalog.latest_price(history).collect()}
    assert got == {1: 1.5, 2: 1.1, 3: 3.0, 4: 4.0}
    older = catalog.latest_price(history.filter("id < 5"))
    newer = catalog.refresh_latest(older, history.filter("id >= 5"))
    assert {r.product_id: r.price for r in newer.collect()} == got


def test_search(goods, history):
    def found(*args, **options):
        return [(r.id, r.latest_price) for r in catalog.search(goods, history, *args, **options).collect()]

    assert found("melk") == [(1, 1.5), (5, None), (3, 3.0), (2, 1.1)]
    assert found("melk", limit=2) == [(1, 1.5), (5, None)]
    assert found("MELK", supermarket="dirk") == [(3, 3.0)]
    assert found("_elk", supermarket="jumbo") == [(2, 1.1)]
    assert found("boter") == []


def test_compare_and_ranking(goods, history):
    items = catalog.compare(goods, history, "melk")
    rows = {r.id: (r.group_name, r.multi_store) for r in items.collect()}
    assert rows == {1: ("melk", True), 2: ("melk", True), 3: ("volle melk", False),
                    5: ("nooit geprijsd melk", False)}
    ranked = [(r.id, r.is_cheapest, r.diff_pct) for r in catalog.rank_offers(items).collect()]
    assert ranked == [(2, True, None), (1, False, 36)]
    single = [(r.group_name, r.latest_price) for r in catalog.single_store_offers(items).collect()]
    assert single == [("nooit geprijsd melk", None), ("volle melk", 3.0)]


def test_histories(goods, history):
    one = catalog.product_history(history, 2).collect()
    assert [(r.price, r.date.day) for r in one] == [(2.0, 1), (1.0, 9), (1.1, 9)]
    several = catalog.product_history(history, products=goods.filter("supermarket = 'ah'"))
    assert {r.product_id for r in several.collect()} == {1, 4}
    nested = {r.id: r.price_history for r in catalog.all_products_with_history(goods, history).collect()}
    assert [e.price for e in nested[1]] == [1.0, 1.2, 1.5] and nested[5] == []
    assert catalog.product_with_history(goods, history, 4).count() == 1
    assert catalog.product_with_history(goods, history, 99).count() == 0


def test_counts(goods, history, mapped):
    totals = catalog.price_totals(history).head()
    assert (totals.total_prices, totals.days) == (9, 5)
    assert catalog.price_totals(history.filter("false")).head().total_prices == 0
    assert catalog.category_total(goods).head().categories == 3
    stores = {r.supermarket: r.products for r in catalog.store_counts(goods).collect()}
    assert stores == {"ah": 3, "jumbo": 1, "dirk": 1, None: 5}
    [row] = catalog.canonical_categories(goods, mapped).collect()
    assert (row.canonical_category, row.product_count) == ("zuivel & eieren", 3)
    published = catalog.canonical_categories(goods, mapped)
    unmapped = mapped.filter("false")
    assert catalog.canonical_categories(goods, unmapped).count() == 0
    assert catalog.canonical_categories(goods, unmapped, published).collect() == [row]
    assert catalog.canonical_categories(goods, mapped, published).collect() == [row]


def test_categories(goods, history, mapped):
    names = {r.id: r.canonical_category for r in catalog.with_canonical_category(goods, mapped).collect()}
    assert names == {1: "zuivel & eieren", 2: "zuivel & eieren", 3: "overig", 4: None, 5: "zuivel & eieren"}
    fits = {r.id for r in catalog.in_category(goods, mapped, "zuivel").collect()}
    assert fits == {1, 5}
    fits = {r.id for r in catalog.in_category(goods, mapped, "zuivel & eieren").collect()}
    assert fits == {1, 2, 5}
    rows = catalog.category_products(goods, history, mapped)
    page = [(r.id, r.position, r.category_size) for r in catalog.category_page(rows, top=2).collect()]
    assert sorted(page, key=lambda r: r[1]) == [(5, 1, 3), (2, 2, 3)]
    ordered = catalog.products_in_category(goods, history, mapped, "zuivel & eieren").collect()
    assert [r.id for r in ordered] == [5, 1, 2]


def test_first_mapping_wins(spark):
    rows = [(2, "b", "ah", "x"), (1, "a", "ah", "x"), (3, "c", "jumbo", "x")]
    df = spark.createDataFrame(
        rows, "n int, canonical_category string, supermarket string, original_category string"
    )
    got = {r.supermarket: r.canonical_category for r in first_mapping(df, "n").collect()}
    assert got == {"ah": "a", "jumbo": "c"}


def test_price_changes(goods, history, mapped):
    def found(**options):
        rows = changes.price_changes(goods, history, 30, AS_OF, category_map=mapped, **options)
        return [(r.id, r.pct_change, r.abs_change) for r in rows.collect()]

    assert found() == [(1, 50.0, 0.5), (2, -45.0, -0.9)]
    # The bound applies to the unrounded change, here 44.99999999999999 %.
    assert found(min_change=44.99) == [(1, 50.0, 0.5), (2, -45.0, -0.9)]
    assert found(min_change=45.0) == [(1, 50.0, 0.5)]
    assert found(supermarket="jumbo") == [(2, -45.0, -0.9)]
    assert found(category="melk") == [(2, -45.0, -0.9)]
    with pytest.raises(ValueError):
        changes.price_changes(goods, history, category="melk")


def test_the_look_back_includes_its_first_day(goods, history):
    # 26 days before 31 March is 5 March.
    rows = changes.first_last_prices(history, 26, AS_OF).collect()
    assert {(r.product_id, r.first_price, r.latest_price) for r in rows} == {
        (1, 1.2, 1.5), (2, 1.0, 1.1), (3, 3.0, 3.0),
    }


def test_movers_and_inflation(goods, history, mapped):
    rows = changes.top_movers(goods, history, 30, AS_OF, threshold=10, rises=1, falls=1).collect()
    assert [(r.direction, r.position, r.id) for r in rows] == [("up", 1, 1), ("down", 1, 2)]
    [category] = changes.inflation_by_category(goods, history, mapped, 30, AS_OF).collect()
    assert (category.category, category.products, category.avg_change_pct) == (
        "zuivel & eieren", 2, 2.5,
    )
    assert (category.max_increase_pct, category.increased, category.decreased) == (50.0, 1, 1)
    by_store = changes.inflation_by_store(goods, history, 30, AS_OF).collect()
    assert [(r.supermarket, r.avg_change_pct) for r in by_store] == [("ah", 50.0), ("jumbo", -45.0)]
    assert sum(r.products for r in by_store) == category.products
    only = changes.inflation_by_category(goods, history, mapped, 30, AS_OF, category="melk")
    assert [r.products for r in only.collect()] == [1]


def test_fake_sales_compare_the_rounded_share(spark, goods):
    # 1999 of 2501 prices are 79.93 %, 2000 of 2501 are 79.97 %, shown as 80.0.
    numbers = spark.range(2501)
    df = None
    for product_id, sales in ((1, 1999), (2, 2000)):
        rows = numbers.select(
            F.col("id"), F.lit(product_id).cast("long").alias("product_id"), F.lit(1.005).alias("price"),
            F.lit(2.0).alias("original_price"), (F.col("id") < sales).cast("int").alias("is_sale"),
            F.lit(day(1)).cast("timestamp_ntz").alias("scraped_at"),
        )
        df = rows if df is None else df.unionByName(rows)
    [row] = changes.fake_sales(goods, df).collect()
    assert (row.id, row.sale_pct, row.sale_count) == (2, 80.0, 2000)
    assert row.avg_price == pytest.approx(1.005)
    few = prices(spark, [(i, 1, 1.0, day(i), 2.0, 1) for i in (1, 2)])
    assert changes.fake_sales(goods, few).count() == 0


def test_price_index(goods, history):
    index = changes.price_index(goods, history)
    rows = {(r.date.day, r.supermarket): (r.avg_price, r.products) for r in index.collect()}
    assert rows[(9, "jumbo")] == (1.05, 2) and rows[(4, "ah")] == (4.0, 1)
    wide = {r.date.day: (r.ah, r.jumbo, r.dirk) for r in changes.price_index_wide(index).collect()}
    assert wide[9] == (1.5, 1.05, 3.0) and wide[5] == (1.2, None, None)


def observations(spark, rows):
    names = OBSERVATIONS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], OBSERVATIONS)


def seen(seq, name, store="ah", **other):
    return dict(seq=seq, name=name, supermarket=store, scraped_at=day(1), price=1.0) | other


def test_resolve_against_the_catalog(spark):
    stored = products(spark, [
        shop(1, "ah", "Melk", unit="1 l", url="u1"), shop(2, "ah", "Kaas", unit="500 g"),
        shop(3, "jumbo", "Melk", unit="1 l", url="u3"), shop(4, "dirk", "Brood", unit="", url=""),
        shop(5, "ah", "Sap", unit="1 l", url="u5"),
    ])
    batch = observations(spark, [
        seen(11, "Andere naam", url="u1"),  # by url
        seen(12, "Melk", unit="1 l", url="new"),  # row 11 has taken the unit, and the url stands
        seen(18, "Sap", unit="1 l", url="new"),  # by name, store and unit
        seen(13, "Kaas", unit="1 kg"),  # by name and store, no url stored
        seen(14, "Melk", "jumbo", unit="2 l", url="u9"),  # name taken
        seen(15, "Melk", "jumbo", url="u3"),
        seen(16, "Melk", "dirk", unit="1 l"),  # new
        seen(17, "Brood", "dirk", unit=""),  # an empty unit is no unit, an empty url is not NULL
    ])
    rows = {r.seq: r for r in ingest.resolve_products(batch, stored).collect()}
    assert {s: r.product_id for s, r in rows.items()} == {11: 1, 12: None, 13: 2, 14: None, 15: 3,
                                                          16: 16, 17: None, 18: 5}
    assert {s for s, r in rows.items() if r.is_new} == {16}
    assert {s for s, r in rows.items() if r.reason} == {12, 14, 17}
    assert rows[13].stored_unit == "500 g"


def test_a_product_without_url_is_closed_by_the_first_url(spark):
    """Row by row: each row sees the url and unit that the row before it has written."""
    stored = products(spark, [shop(k, "ah", f"N{k}", unit="1 l") for k in range(1, 6)])
    rows = [
        seen(11, "N1", unit="1 l", url="a"), seen(12, "N1", unit="2 l", url="b"),
        seen(13, "N1", unit="1 l", url="b2"), seen(21, "N2", unit="3 l"),
        seen(22, "N2", unit="5 l", url="c"), seen(23, "N2", unit="5 l", url="d"),
        seen(24, "N2", unit="6 l", url="e"), seen(31, "N3", unit="8 l"), seen(32, "N3"),
        seen(41, "N4", url="f"), seen(42, "N4", url="g"),
    ]
    catalog_now = {k: {"name": f"N{k}", "unit": "1 l", "url": None} for k in range(1, 6)}

    def place(row):
        tests = (
            lambda p: row.get("url") and p["url"] == row["url"],
            lambda p: p["name"] == row["name"] and row.get("unit") and p["unit"] == row["unit"],
            lambda p: p["name"] == row["name"] and p["url"] is None,
        )
        return next((k for fits in tests for k, p in catalog_now.items() if fits(p)), None)

    want = {}
    for row in rows:
        want[row["seq"]] = found = place(row)
        if found:
            catalog_now[found].update(url=row.get("url"), unit=row.get("unit"))
    got = ingest.resolve_products(observations(spark, rows), stored).collect()
    assert {r.seq: r.product_id for r in got} == want
    assert [k for k, found in want.items() if found is None] == [12, 24, 42]


def test_resolve_within_a_batch(spark):
    batch = observations(spark, [
        seen(1, "A", unit="1 l", url="u1"), seen(2, "A", unit="1 l", url="u1", price=2.0),
        seen(3, "B", url="u1"),  # another name under the same url
        seen(4, "A", unit="1 l"),  # row 3 has taken the unit, and the url stands
        seen(5, "A", unit="2 l", url="u5"),  # duplicate name
        seen(6, "C"), seen(7, "C", url="u7", unit="x"),  # creator without url
        seen(8, "B", url="u8"), seen(9, "A", "jumbo", url="u9"),
    ])
    empty = products(spark, [])
    resolved = ingest.resolve_products(batch, empty)
    got = {r.seq: r.product_id for r in resolved.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: 6, 7: 6, 8: 8, 9: 9}
    catalog_after = {r.id: r for r in ingest.upsert_products(resolved, empty).collect()}
    assert set(catalog_after) == {1, 6, 8, 9}
    # The last observation of product 1 has no unit, and that overwrites; its name stays.
    assert (catalog_after[1].url, catalog_after[1].unit, catalog_after[1].name) == ("u1", None, "A")
    assert (catalog_after[6].url, catalog_after[6].unit) == ("u7", "x")


def test_first_valid_price_of_a_day(spark):
    rows = [
        seen(1, "A", price=0.0), seen(2, "A", price=500.01), seen(3, "A", price=500.0),
        seen(4, "A", price=2.0), seen(5, "A", price=3.0, scraped_at=day(2), original_price=0.0),
        seen(6, "A", price=float("nan"), scraped_at=day(3)), seen(7, "A", price=None, scraped_at=day(3)),
    ]
    batch = observations(spark, rows).withColumn("product_id", F.lit(1).cast("long"))
    firsts = ingest.first_price_per_day(batch)
    assert {(r.id, r.price, r.original_price, r.is_sale) for r in firsts.collect()} == {
        (3, 500.0, 500.0, 0), (5, 3.0, 3.0, 0),
    }
    stored = prices(spark, [(90, 1, 9.0, day(2, 23))])
    assert [r.id for r in ingest.first_price_per_day(batch, stored).collect()] == [3]
    reasons = {r.seq: r.reason for r in ingest.rejected_prices(batch).collect()}
    assert reasons == {1: "price_not_positive", 2: "price_too_high", 6: "price_missing",
                       7: "price_missing"}


def test_unit_changes_hide_behind_a_missing_unit(spark):
    units = [(1, 1, "500 g"), (2, 1, "450 g"), (3, 1, None), (4, 1, "400 g"), (5, 1, "400 g"), (6, 2, "x"),
             (7, 2, ""), (8, 2, "y"), (9, 2, "z")]
    df = spark.createDataFrame(units, "seq long, product_id long, unit string").withColumn(
        "scraped_at", F.lit(day(1)).cast("timestamp_ntz")
    )
    for slice_rows in (1, 1000):
        rows = ingest.detect_unit_changes(df, slice_rows).collect()
        assert {(r.id, r.old_unit, r.new_unit) for r in rows} == {(2, "500 g", "450 g"), (9, "y", "z")}
    against = ingest.detect_unit_changes(df.withColumn("stored_unit", F.lit("1 kg"))).collect()
    assert {r.id for r in against} == {1, 2, 6, 9}


def test_sale_flags(spark):
    df = prices(spark, [(1, 1, 1.0, day(1), 1.0, 1), (2, 1, 1.0, day(2), None, 1), (3, 1, 1.0, day(3), 2.0, 1)])
    assert {r.id: r.is_sale for r in ingest.clean_false_sales(df).collect()} == {1: 0, 2: 0, 3: 1}
    stats = ingest.day_stats(df, "2026-03-02").head()
    assert (stats.products, stats.prices) == (1, 1)


def test_normalization(spark):
    df = products(spark, [shop(1, "ah", "AH Melk", unit="1,5 l"), shop(2, "ah", "Iets", unit="20 rollen"),
                          shop(3, "ah", "Los", unit="per stuk", unit_quantity=9.0)])
    done = normalize.normalize(df, prices(spark, [(1, 1, 3.0, day(1)), (2, 2, 3.0, day(1))]))
    rows = {r.id: r for r in done.collect()}
    assert (rows[1].unit_quantity, rows[1].unit_type, rows[1].price_per_unit) == (1500.0, "ml", 2.0)
    assert (rows[2].unit_quantity, rows[2].unit_type, rows[2].price_per_unit) == (None, None, None)
    assert (rows[3].unit_quantity, rows[3].price_per_unit) == (1.0, None)
    stats = normalize.normalization_stats(done).head()
    assert (stats.parsed, stats.skipped, stats.total) == (2, 1, 3)


def test_slug_collisions_are_counted(spark):
    categories = spark.createDataFrame([("Kaas & Co",), ("kaas-co",)], "canonical_category string")
    comparison = spark.createDataFrame([("melk", True), ("melk", False)], "slug string, is_cheapest boolean")
    urls = {(r.kind, r.slug): (r.priority, r.pages) for r in publish.site_urls(categories, comparison).collect()}
    assert urls[("category", "kaas-co")] == (0.8, 2)
    assert urls[("comparison", "melk")] == (0.7, 1)
    assert len(urls) == 6
