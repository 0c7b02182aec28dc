"""Products, prices, observations and captured pages derived from the supplied tables.

Every frame covers the whole of its source table. Ids are computed from each row alone, so no
query needs a global sort for numbering.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.operators import ingest
from pricetrail.operators.normalize import normalize
from pricetrail.plans.joins import join_counted

# Arrival number of a price: grows with ship date, order, line; unique over the table.
PRICE_ID = (
    "((datediff(l_shipdate, DATE'1995-01-01') * 68719476736L + l_orderkey) * 8 + l_linenumber)"
    " * 4096 + (l_partkey * 31 + l_suppkey) % 4096"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of all stores, spread over the cores: a file of a few MB is read by one task, but has
    millions of rows, and texts are parsed in the tasks that hold them."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = table(spark, sf_dir, "part").repartition(tasks, "p_partkey")
    return parts.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("s"))


PRODUCT_COLUMNS = [
    "p_partkey * 3 + s AS id",
    """CASE s WHEN 0 THEN 'AH ' WHEN 1 THEN 'Jumbo ' ELSE '' END
       || CASE WHEN s = 1 AND p_partkey % 3 = 0 THEN replace(p_name, 'i', 'y')
               WHEN s = 2 AND p_partkey % 5 = 0 THEN p_name || 's' ELSE p_name END
       || ' ' || p_brand || CASE WHEN p_size % 4 = 0 THEN ' 500g' ELSE '' END AS name""",
    "CASE s WHEN 0 THEN 'AH' WHEN 1 THEN 'Jumbo' END AS brand",
    "lower(p_type) || CASE s WHEN 0 THEN ' a' WHEN 1 THEN ' b' ELSE ' c' END AS category",
    """CASE p_size % 10
         WHEN 0 THEN CAST(p_size AS STRING) || '0 g'
         WHEN 1 THEN 'per stuk'
         WHEN 2 THEN '6 x ' || CAST(p_size AS STRING) || '0 ml'
         WHEN 3 THEN '1,5 L'
         WHEN 4 THEN '2+ dagen houdbaar • ' || CAST(p_size AS STRING) || '0 g'
         WHEN 5 THEN CAST(p_size AS STRING) || ' wasbeurten'
         WHEN 6 THEN '75 cl'
         WHEN 7 THEN CAST(p_size AS STRING) || ' stuks'
         WHEN 8 THEN NULL
         ELSE '1 kg (ca. 10 stuks)' END AS unit""",
    "CASE s WHEN 0 THEN 'ah' WHEN 1 THEN 'jumbo' ELSE 'dirk' END AS supermarket",
    "'https://store.example/' || CAST(p_partkey * 3 + s AS STRING) AS url",
    "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
]


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts_by_store(spark, sf_dir)
    return ingest.add_missing_columns(parts.selectExpr(*PRODUCT_COLUMNS))


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey * 3 + l_suppkey % 3 AS product_id",
        "floor(l_extendedprice / 2) / 100 AS price",
        """CASE WHEN l_discount < 0.005 THEN NULL
                WHEN l_discount > 0.045 AND l_discount < 0.055 THEN floor(l_extendedprice / 2) / 100
                ELSE floor(l_extendedprice * 0.6) / 100 END AS original_price""",
        "CASE WHEN l_discount > 0.025 THEN 1 ELSE 0 END AS is_sale",
        "l_shipdate AS scraped_at",
        f"{PRICE_ID} AS id",
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored prices: first valid one per product and day, sale flags cleaned."""
    observed = raw_prices(spark, sf_dir).withColumnRenamed("id", "seq")
    return ingest.clean_false_sales(ingest.first_price_per_day(observed))


def normalized_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(products(spark, sf_dir), prices(spark, sf_dir))


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store categories of all types but PROMO, which stays unmapped."""
    suffixes = F.explode(
        F.array(
            *(
                F.struct(F.lit(store).alias("supermarket"), F.lit(suffix).alias("suffix"))
                for store, suffix in (("ah", " a"), ("jumbo", " b"), ("dirk", " c"))
            )
        )
    )
    types = table(spark, sf_dir, "part").select("p_type").distinct().filter("p_type <> 'PROMO'")
    return types.select("p_type", suffixes.alias("x")).selectExpr(
        """CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'budget' WHEN p_type = 'LARGE' THEN 'bulk'
                ELSE 'regular' END AS canonical_category""",
        "x.supermarket AS supermarket",
        "lower(p_type) || x.suffix AS original_category",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw prices as observations of their products, with the true product as `known_id`."""
    info = products(spark, sf_dir).select(
        F.col("id").alias("product_id"), "supermarket", "category", "name", "brand", "unit", "url"
    )
    joined = join_counted(raw_prices(spark, sf_dir), info, ["product_id"])
    return joined.selectExpr(
        "id AS seq", "scraped_at", "supermarket", "category", "name", "brand",
        """CASE WHEN product_id % 9 = 4 AND id % 4 = 0 THEN NULL
                WHEN scraped_at >= TIMESTAMP_NTZ'1999-01-01 00:00:00' AND unit LIKE '%0 g'
                THEN replace(unit, '0 g', '5 g') ELSE unit END AS unit""",
        # No url at all, none now and then, now and then that of another name, a new one from a day on.
        """CASE WHEN product_id % 11 = 0 OR (product_id % 5 = 1 AND id % 3 = 0) THEN NULL
                WHEN product_id % 40 = 2 AND id % 2 = 0
                THEN 'https://store.example/' || CAST(product_id + 3 AS STRING)
                WHEN product_id % 7 = 3 AND scraped_at >= TIMESTAMP_NTZ'1998-01-01 00:00:00'
                THEN url || '?v=2' ELSE url END AS url""",
        "price", "original_price", "is_sale", "product_id AS known_id",
    )


def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog as earlier runs would have left it: one product per name and store."""
    known = products(spark, sf_dir)
    first = F.min(F.struct("id", *(c for c in known.columns if c not in ("id", "name", "supermarket"))))
    one = known.groupBy("name", "supermarket").agg(first.alias("p")).select("name", "supermarket", "p.*")
    url = F.when(F.col("id") % 7 != 0, F.col("url"))
    return one.withColumn("url", url).select(*known.columns)


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS product_id", "value AS price", "ts AS scraped_at",
        "CAST(NULL AS DOUBLE) AS original_price", "0 AS is_sale",
    )


# Cards: price in cents, an old price above or below it, a size or none.
_CARD_FIELDS = [
    "*",
    "CAST((p_partkey * 37 + s * 11) % 4900 + 20 AS INT) AS cents",
    """CASE p_size % 3 WHEN 0 THEN CAST((p_partkey * 37 + s * 11) % 4900 + 70 AS INT)
                       WHEN 1 THEN CAST((p_partkey * 37 + s * 11) % 4900 + 10 AS INT) END AS old""",
    "CASE WHEN p_size % 5 = 0 THEN ' &amp; co' ELSE '' END AS tail",
    # What misleads a reader without a DOM: brackets in values, comments, articles inside cards, scripts.
    "CASE WHEN p_size % 6 = 1 THEN ' > groot' ELSE '' END AS bracket",
    "CASE WHEN p_size % 9 = 2 THEN '<!-- </div></article><span class=\"whole\">0</span> -->' ELSE '' END AS note",
    """CASE WHEN p_size % 8 = 3 THEN '<article class="promo"><div><p>Nieuw</p></div></article>'
            WHEN p_size % 8 = 4 THEN '<script>if (a < b) x = "</article>";</script>' ELSE '' END AS promo""",
]


def _euros(cents: str) -> str:
    return f"CAST({cents} DIV 100 AS STRING)"


def _cents(cents: str) -> str:
    return f"lpad(CAST({cents} % 100 AS STRING), 2, '0')"


_AH_CARD = f"""
  '<article data-x="' || bracket || '" data-testid="product-card">' || promo
  || '<a href="/producten/product/' || id || '" title="Bekijk '
  || name || tail || bracket || '"></a><div data-testid="price-amount">' || note || '<div>nu</div><span class="x integer">'
  || {_euros("cents")} || '</span><span class="x fractional">' || {_cents("cents")}
  || '</span></div>' || CASE WHEN p_size % 7 = 0
      THEN '<div data-testid="product-shield"><div>-</div><b>Bonus</b></div>' ELSE '' END
  || coalesce('<span data-testid="price-was"><span>&nbsp;</span>' || {_euros("old")} || ',' || {_cents("old")}
              || '</span>', '')
  || coalesce('<span data-testid="product-unit-size"><span></span>' || unit || '</span>', '') || '</article>'"""
_JUMBO_CARD = f"""
  '<article title="' || bracket || '" class="card product-container">' || promo
  || '<h3><a title="' || bracket || '" class="title-link" href="/p/' || id || '">'
  || name || tail || note || '</a></h3>'
  || coalesce('<div class="old-price"><div>was</div><span class="whole">' || {_euros("old")}
              || '</span><span class="fractional">' || {_cents("old")} || '</span></div>', '')
  || CASE WHEN p_size % 2 = 0 THEN '' ELSE
       coalesce('<span class="jum-card-subtitle"><span> </span>' || unit || ' </span>', '') END
  || '<div class="current-price">' || note || '<div><div></div>nu</div><span class="whole">' || {_euros("cents")}
  || '</span><span class="fractional">' || {_cents("cents")} || '</span></div></article>'"""
_DIRK_CARD = f"""
  '<article title="' || bracket || '" data-product-id="' || id || '">' || promo
  || '<a class="bottom" href="/p/' || id || '"><p class="title">' || name || tail || note || '</p>'
  || coalesce('<span class="subtitle"><span></span>' || unit || '</span>', '') || '</a>'
  || CASE WHEN p_size % 4 = 1 THEN '<div class="logos"><div></div><img src="l.png" alt="1 de Beste"></div>'
     ELSE '' END
  || coalesce('<div class="old-price"><div></div><span class="price-large">' || {_euros("old")}
              || '</span><span class="price-small">' || {_cents("old")} || '</span></div>', '')
  || '<div class="price-container">' || note || '<div>nu</div><div class="price"><div></div>' || CASE WHEN cents < 100
      THEN '<span class="price-large">' || cents || '</span>'
      ELSE '<span class="hasEuros price-large">' || {_euros("cents")}
           || '</span><span class="price-small">' || {_cents("cents")} || '</span>' END
  || '</div></div></article>'"""
_PAGE_URL = """CASE s
  WHEN 0 THEN 'https://www.ah.nl' || CASE page % 2 WHEN 0 THEN '/producten/9344/vlees?page=1'
                                     ELSE '/producten/1192/kaas' END
  WHEN 1 THEN 'https://www.jumbo.com' || CASE page % 2 WHEN 0 THEN '/producten/koffie-en-thee/'
                                         ELSE '/producten/diepvries/' END
  ELSE 'https://www.dirk.nl' || CASE page % 2 WHEN 0 THEN '/boodschappen/zuivel-kaas/melk'
                                ELSE '/boodschappen/elders/melk' END END"""

PAGE_CARDS = 40


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of PAGE_CARDS product cards each, in the layout of their store."""
    cards = (
        _parts_by_store(spark, sf_dir)
        .selectExpr("p_partkey", "p_size", "s", f"p_partkey DIV {PAGE_CARDS} AS page",
                    *PRODUCT_COLUMNS[:2], *PRODUCT_COLUMNS[4:6])
        .selectExpr(*_CARD_FIELDS)
        .selectExpr(
            "p_partkey", "s", "page", "supermarket",
            f"CASE s WHEN 0 THEN {_AH_CARD} WHEN 1 THEN {_JUMBO_CARD} ELSE {_DIRK_CARD} END AS card",
        )
    )
    # At most PAGE_CARDS cards share a page.
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", "card")))
    return (
        cards.groupBy("page", "s", "supermarket")
        .agg(F.array_join(ordered["card"], "\n").alias("body"))
        .selectExpr(
            "page * 3 + s AS page_seq", f"{_PAGE_URL} AS url", "supermarket",
            "TIMESTAMP_NTZ'2026-03-11 06:00:00' AS captured_at",
            "'<html><body>' || body || '</body></html>' AS html",
        )
    )
