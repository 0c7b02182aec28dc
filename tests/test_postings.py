import pytest
from helpers import day, prices, products
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import supplied as sup
from pricetrail.operators import catalog, postings

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    ("AH Volle Melk", "volle melk"), ("volle MELK 1 l", None), ("me", "me"), (None, None), ("", ""),
    ("Crème brûlée", "crème brûlée"), ("100% fruit_sap", "fruit"), ("a\\bc d", "other melk"),
    ("MELKMELKMELK", ""), ("ÉÉÉ", "ééé"), ("\U0001f600\U0001f600x melk", "x"), ("Volle Melk", "volle melk"),
]
TERMS = ["melk", "MELK", "vol_e", "lle%1", "me", "", "%", "_elk", "\\bc", "a\\b", "100%", "ÉÉÉ", "ééé", "zzz",
         "melkm", "e br", "\U0001f600\U0001f600x", "volle melk", "k%volle", "other"]


@pytest.fixture(scope="module")
def shop(spark):
    goods = products(spark, [
        dict(id=k, supermarket=("ah", "jumbo", "dirk")[k % 3], name=name, category="c", normalized_name=other)
        for k, (name, other) in enumerate(NAMES)
    ])
    history = prices(spark, [(k, k, 1.0 + k, day(1 + k)) for k in range(0, len(NAMES), 2)])
    lists = postings.by_gram(postings.name_postings(goods)).cache()
    return goods, history, lists, postings.gram_sizes(lists).cache()


def rows(df):
    return [tuple(r) for r in df.select(sorted(df.columns)).collect()]


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_the_scan(shop, term):
    goods, history, lists, sizes = shop
    for limit, store in ((50, None), (2, None), (50, "ah")):
        want = rows(catalog.search(goods, history, term, limit, store))
        assert rows(postings.search(goods, history, lists, sizes, term, limit, store)) == want
    want = sorted(rows(catalog.compare(goods, history, term)), key=repr)
    assert sorted(rows(postings.compare(goods, history, lists, sizes, term)), key=repr) == want


TEXT = st.text("abAB é\U0001f600", max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_grams_are_those_of_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    upper = str.maketrans("AB", "ab")
    for row in df.select("t", postings.grams(df.t).alias("g")).collect():
        folded = row.t.translate(upper)
        assert sorted(row.g) == sorted({folded[k : k + 3] for k in range(len(folded) - 2)})
        assert sorted(row.g) == postings.term_grams(row.t)


def test_refreshed_postings_are_those_of_the_new_catalog(spark, shop):
    goods, _, lists, _ = shop
    changed = products(spark, [
        dict(id=1, supermarket="jumbo", name="Karnemelk", category="c", normalized_name="karnemelk"),
        dict(id=99, supermarket="ah", name="Kaas", category="c", normalized_name=None),
        dict(id=5, supermarket="dirk", name="x", category="c", normalized_name=None),
    ])
    new = goods.join(changed, "id", "left_anti").select(goods.columns).unionByName(changed)
    got = rows(postings.refresh_postings(lists, changed))
    assert sorted(got, key=repr) == sorted(rows(postings.name_postings(new)), key=repr)


def test_empty_catalog(shop):
    goods, history, lists, sizes = shop
    none = lists.limit(0)
    assert rows(postings.search(goods.limit(0), history, none, postings.gram_sizes(none), "melk")) == []
    assert postings.name_postings(goods.limit(0)).count() == 0


def test_scans_are_filtered(spark, tmp_path):
    """One trigram's list is read, and of the catalog only rows whose ids are given."""
    goods, history = sup.normalized_products(spark, SF_DIR), sup.prices(spark, SF_DIR)
    goods.write.parquet(f"{tmp_path}/products")
    postings.by_gram(postings.name_postings(goods)).write.parquet(f"{tmp_path}/lists")
    goods, lists = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("products", "lists"))
    sizes = postings.gram_sizes(lists)
    term = goods.where("name IS NOT NULL").first().name[:5]
    found = postings.lookup(lists, sizes, term)
    assert "EqualTo(gram," in found._jdf.queryExecution().executedPlan().toString()
    df = postings.search(goods, history, lists, sizes, term, 5)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [" in text or "EqualTo(id," in text
    assert rows(df) == rows(catalog.search(goods, history, term, 5))


def test_a_frequent_trigram_is_spread(spark):
    """A trigram that every name has is stored in several ranges, none of them with all its rows."""
    goods = spark.range(20000).selectExpr(
        "id", "'ah' AS supermarket", "concat('abc', id) AS name", "CAST(NULL AS string) AS normalized_name"
    )
    # So small a table would be read as one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = postings.by_gram(postings.name_postings(goods)).withColumn("at", F.spark_partition_id())
        ordered = ordered.where("gram = 'abc'")
        sizes = [r["count"] for r in ordered.groupBy("at").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20000 and max(sizes) < 20000
