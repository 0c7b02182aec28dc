import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import ingest
from pricetrail.plans import runs
from pricetrail.schemas import MATCH_MEMBERS, MATCHES, OBSERVATIONS
from pricetrail.sources.reference_data import category_map
from pricetrail.sources.store import PriceStore
from pricetrail.streaming.ingest_stream import ingest_stream

D1, D2, D3 = (dt.datetime(2026, 3, day, 6) for day in (11, 12, 13))


def row(seq, at, store, name, price, unit=None, url=None, original=None, sale=0, category="vlees", brand=None):
    return (seq, at, store, category, name, brand, unit, url, price, original, sale)


FIRST = [
    row(1, D1, "ah", "AH Volle melk 1 L", 1.0, "1 l", "u1", category="zuivel & eieren"),
    row(2, D1, "jumbo", "Jumbo Volle melk", 1.2, "1 l", "u2", category="zuivel, eieren & boter"),
    row(3, D1, "dirk", "Kaas", 600.0, "500 g", "u3", category="zuivel & kaas"),
    row(4, D1, "dirk", "Kaas", 5.0, "500 g", "u3", category="zuivel & kaas"),
    row(5, D1, "ah", "AH Volle melk 1 L", 1.1, "1 l", "u1", category="zuivel & eieren"),
    row(6, D1, "ah", "AH Volle melk 1 L", 2.0, "2 l", "u9", category="zuivel & eieren"),
]
SECOND = [
    row(11, D2, "ah", "AH Volle melk 1 L", 1.6, "900 ml", "u1", 2.0, 1, category="zuivel & eieren"),
    row(12, D2, "dirk", "Kaas", 5.0, None, "u3", 5.0, 1, category="zuivel & kaas"),
    row(13, D2, "jumbo", "Jumbo Halfvolle melk", 0.9, "1 l", "u4", category="zuivel, eieren & boter"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, OBSERVATIONS)


def stored_prices(store):
    return sorted((r.product_id, r.scraped_at, r.price, r.is_sale) for r in store.prices().collect())


EXPECTED = [(1, D1, 1.0, 0), (1, D2, 1.6, 1), (2, D1, 1.2, 0), (4, D1, 5.0, 0), (4, D2, 5.0, 0),
            (13, D2, 0.9, 0)]


def check_store(store):
    # The price of 600 is rejected, but its row names the product.
    prices = [(3 if p == 4 else p, *rest) for p, *rest in EXPECTED]
    assert stored_prices(store) == sorted(prices)
    products = {r.id: r for r in store.products().collect()}
    assert set(products) == {1, 2, 3, 13}
    assert products[1].unit == "900 ml" and products[1].normalized_name == "volle melk 1 l"
    assert products[1].price_per_unit == pytest.approx(1.6 / 900 * 1000)
    assert products[3].unit is None and products[3].created_at == D1
    changes = [(r.product_id, r.old_unit, r.new_unit) for r in store.unit_changes().collect()]
    assert changes == [(1, "1 l", "900 ml")]
    latest = {r.product_id: r.price for r in store.latest().collect()}
    assert latest == {1: 1.6, 2: 1.2, 3: 5.0, 13: 0.9}


def test_ingest_runs(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"))
    summary = {r.supermarket: r for r in runs.ingest_run(store, frame(spark, FIRST), 0)}
    assert (summary[None].scraped, summary[None].inserted) == (5, 3)
    assert (summary["dirk"].rejected, summary["ah"].errors) == (1, 1)
    runs.ingest_run(store, frame(spark, SECOND), 1)
    check_store(store)
    # A finished run is not repeated; the same observations again change nothing.
    assert runs.ingest_run(store, frame(spark, SECOND), 1) == []
    runs.ingest_run(store, frame(spark, SECOND), 2)
    check_store(store)
    jumps = spark.read.parquet(str(tmp_path / "store/price_jumps/run=1")).collect()
    assert [(r.product_id, r.previous_price, r.price) for r in jumps] == [(1, 1.0, 1.6)]
    rejects = spark.read.parquet(str(tmp_path / "store/rejects/run=0")).collect()
    assert {(r.seq, r.reason) for r in rejects} == {(3, "price_too_high"), (6, "duplicate_name")}
    with pytest.raises(RuntimeError):
        runs.ingest_run(store, frame(spark, []), 3)
    assert store.last_run() == 2


def test_an_unfinished_run_is_invisible(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path))
    runs.ingest_run(store, frame(spark, FIRST), 0)
    before = stored_prices(store)
    # What a run leaves behind when its driver is lost before the end.
    broken = frame(spark, SECOND).withColumnRenamed("seq", "id").withColumn("product_id", F.lit(1).cast("long"))
    store.write_by_day("prices", 1, broken.select("id", "product_id", "price", "original_price",
                                                  "is_sale", "scraped_at"), "scraped_at")
    assert stored_prices(store) == before
    runs.ingest_run(store, frame(spark, SECOND), 1)
    check_store(store)


def test_a_stream_has_its_own_numbers(spark, tmp_path):
    """Streams and batch runs share a store; a batch of errors only does not hold up a stream."""
    store = PriceStore(spark, str(tmp_path / "store"))
    runs.ingest_run(store, frame(spark, FIRST[:2]), 0)
    runs.ingest_run(store, frame(spark, FIRST[2:]), 1)
    source = tmp_path / "in"
    twice = [row(20 + i, D2, "ah", "AH Volle melk 1 L", 2.0, "3 l", f"x{i}") for i in range(3)]
    frame(spark, twice).coalesce(1).write.parquet(str(source / "a"))
    for checkpoint in ("c1", "c2"):
        stream = ingest_stream(store, str(source / "*"), str(tmp_path / checkpoint))
        stream.awaitTermination()
        assert stream.exception() is None
    assert store.last_run() == 3
    rejects = spark.read.parquet(str(tmp_path / "store/rejects/run=2")).collect()
    assert {r.reason for r in rejects} == {"duplicate_name"}
    frame(spark, SECOND).coalesce(1).write.parquet(str(source / "b"))
    stream = ingest_stream(store, str(source / "*"), str(tmp_path / "c1"))
    stream.awaitTermination()
    check_store(store)


def test_stream_equals_batches(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    frame(spark, FIRST).coalesce(1).write.parquet(str(source / "a"))
    frame(spark, SECOND).coalesce(1).write.parquet(str(source / "b"))
    store = PriceStore(spark, root)
    query = ingest_stream(store, str(source / "*"), str(tmp_path / "offsets"), files_per_run=1)
    query.awaitTermination()
    check_store(store)
    query = ingest_stream(store, str(source / "*"), str(tmp_path / "offsets"), files_per_run=1)
    query.awaitTermination()
    check_store(store)


def read_json(path):
    rows = []
    for file in sorted(path.rglob("part-*.json")):
        rows += [json.loads(line) for line in file.read_text().splitlines()]
    return rows


def test_match_publish_and_export(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"))
    runs.ingest_run(store, frame(spark, FIRST), 0)
    runs.ingest_run(store, frame(spark, SECOND), 1)
    products, prices, mapped = store.products(), store.prices(), category_map(spark)
    matches, members = runs.match_run(
        products, mapped, spark.createDataFrame([], MATCHES),
        spark.createDataFrame([], MATCH_MEMBERS), D2,
    )
    assert [(r.id, r.canonical_name, r.match_type) for r in matches.collect()] == [
        (1, "volle melk", "exact")
    ]
    again, _ = runs.match_run(products, mapped, matches, members, D3)
    assert again.count() == 1
    site = tmp_path / "site"
    runs.publish_run(products, prices, store.unit_changes(), mapped, matches, members, str(site),
                     D2.date(), D2)
    assert read_json(site / "categories") == [
        {"canonical_category": "zuivel & eieren", "product_count": 4}
    ]
    assert (site / "category/category_slug=zuivel-eieren").is_dir()
    assert {p.name for p in (site / "products").iterdir() if p.is_dir()} == {
        "supermarket=ah", "supermarket=jumbo", "supermarket=dirk",
    }
    [mover] = read_json(site / "movers")
    assert (mover["id"], mover["pct_change"], mover["abs_change"]) == (1, 60.0, 0.6)
    assert read_json(site / "price_index") == [
        {"date": "2026-03-11", "ah": 1.0, "jumbo": 1.2, "dirk": 5.0},
        {"date": "2026-03-12", "ah": 1.6, "jumbo": 0.9, "dirk": 5.0},
    ]
    urls = {(u["kind"], u["slug"]) for u in read_json(site / "urls")}
    assert urls == {("page", ""), ("page", "categorieen"), ("page", "over"), ("page", "privacy"),
                    ("category", "zuivel-eieren"), ("comparison", "volle-melk")}
    table = {r["product_id"]: r for r in read_json(site / "comparison")}
    assert table[2]["is_cheapest"] and table[1]["diff_pct"] == 48  # 1.78 against 1.20 per litre
    [meta] = read_json(site / "meta")
    assert (meta["product_count"], meta["price_count"], meta["days"]) == (4, 6, 2)

    runs.export_run(products, prices, str(tmp_path / "export"), D2.date())
    exported = read_json(tmp_path / "export/prices_latest")
    assert [p["id"] for p in exported] == [1, 3, 13, 2]
    assert exported[0]["price_history"][1]["is_sale"] is True
    assert read_json(tmp_path / "export/prices_2026-03-12") == exported


def test_csv_quotes(spark, tmp_path):
    awkward = [row(1, D1, "ah", 'Kaas, "oud"\njong', 1.0, url="u")]
    store = PriceStore(spark, str(tmp_path / "store"))
    runs.ingest_run(store, frame(spark, awkward), 0)
    runs.export_run(store.products(), store.prices(), str(tmp_path / "out"), D1.date())
    back = spark.read.csv(str(tmp_path / "out/prices_2026-03-11_csv"), header=True, quote='"',
                          escape='"', multiLine=True)
    [r] = back.collect()
    assert (r["name"], r["is_sale"], r["price"]) == ('Kaas, "oud"\njong', "nee", "1.0")


def test_old_catalogs_get_the_new_columns(spark):
    old = spark.createDataFrame([(1, "Kaas", "ah")], "id long, name string, supermarket string")
    new = ingest.add_missing_columns(old)
    assert ingest.add_missing_columns(new).columns == new.columns
    assert dict(new.dtypes)["unit_quantity"] == "double"


