from pyspark.sql import functions as F

from pricetrail.sources import pages as pg
from pricetrail.sources.reference_data import category_map, category_paths

AH = """<html><body>
<article data-testid="product-card"><a href="/producten/product/1" title="Bekijk AH Melk &amp; meer"></a>
<div data-testid="price-amount"><span class="x integer">1</span><span class="x fractional">45</span></div>
<span data-testid="price-was">1,99</span><span data-testid="product-unit-size">1,5 l</span></article>
<article class="y" data-testid="product-card"><a title="Bekijk Kaas" href="/producten/product/2"></a>
<div data-testid="price-amount"><span class="integer">2</span><span class="fractional">00</span></div>
<div data-testid="product-shield"><b>2e Halve prijs</b></div><span data-testid="price-was">1.50</span></article>
<article data-testid="product-card"><a href="/producten/product/3" title=""></a>
<div data-testid="price-amount"><span class="integer">1</span><span class="fractional">45</span></div></article>
<article data-testid="product-card"><a href="/producten/product/4" title="Bekijk Geen prijsvak"></a></article>
<article data-testid="product-card"><a href="/producten/product/5" title="Bekijk Nul"></a>
<div data-testid="price-amount"><span class="integer">0</span><span class="fractional">00</span></div></article>
<article data-testid="other"><a href="/producten/product/6" title="Bekijk Ander"></a></article>
</body></html>"""
JUMBO = """
<article class="product-container"><h3><a class="title-link" href="/p/2">Jumbo Cola 6 x 330 ml</a></h3>
<div class="current-price"><span class="whole">3</span><span class="fractional">49</span></div></article>
<article class="card product-container big"><h3><a class="title-link" href="">Brie 200 g</a></h3>
<div class="old-price"><span class="whole">3</span><span class="fractional">00</span></div>
<div class="jum-card-subtitle"> 200 gram </div>
<div class="current-price"><span class="whole">2</span><span class="fractional">50</span></div></article>
<article class="product-container"><h3><a class="title-link" href="/p/3">Peer per stuk</a></h3>
<div class="old-price"><span class="whole">0</span><span class="fractional">50</span></div>
<div class="current-price"><span class="whole">0</span><span class="fractional">60</span></div></article>
<article class="product-container"><h3><a class="title-link" href="/p/4">Zonder prijs</a></h3></article>"""
DIRK = """
<article data-product-id="3"><a class="bottom" href="/p/3"><p class="title">Appels</p>
<span class="subtitle">1 kg</span></a><div class="price-container"><div class="price">
<span class="price-large">85</span></div></div></article>
<article data-product-id="4"><a class="top" href="/p/4t"></a><p class="title">Boter</p>
<div class="logos"><img src="x" alt="1 De Beste logo"></div>
<div class="old-price"><span class="price-large">2</span><span class="price-small">49</span></div>
<div class="price-container"><div class="price"><span class="hasEuros price-large">1</span>
<span class="price-small">99</span></div></div></article>
<article data-product-id="5"><p class="title"></p><div class="price-container"><div class="price">
<span class="price-large">85</span></div></div></article>"""


def observations(spark):
    rows = [
        (1, "https://www.ah.nl/producten/9344/vlees?page=2&withOffset=true", "ah", AH),
        (2, "https://www.jumbo.com/producten/koffie-en-thee/", "jumbo", JUMBO),
        (3, "https://www.dirk.nl/boodschappen/zuivel-kaas/kaas", "dirk", DIRK),
    ]
    df = spark.createDataFrame(rows, "page_seq long, url string, supermarket string, html string")
    df = df.withColumn("captured_at", F.lit("2026-03-11 06:00:00").cast("timestamp_ntz"))
    found = pg.extract_observations(pg.attach_category(df, category_paths(spark)))
    return {
        (r.supermarket, r.name): (r.price, r.original_price, r.is_sale, r.unit, r.brand, r.url, r.category, r.seq)
        for r in found.collect()
    }


def test_cards_of_three_layouts(spark):
    assert observations(spark) == {
        ("ah", "AH Melk & meer"): (1.45, 1.99, 1, "1,5 l", "AH",
            "https://www.ah.nl/producten/product/1", "vlees", 100_000),
        ("ah", "Kaas"): (2.0, None, 1, None, None,
            "https://www.ah.nl/producten/product/2", "vlees", 100_001),
        ("jumbo", "Jumbo Cola 6 x 330 ml"): (3.49, None, 0, "6 x 330 ml", "Jumbo",
            "https://www.jumbo.com/p/2", "koffie & thee", 200_000),
        ("jumbo", "Brie 200 g"): (2.5, 3.0, 1, "200 gram", None, None, "koffie & thee", 200_001),
        ("jumbo", "Peer per stuk"): (0.6, None, 0, "per stuk", None,
            "https://www.jumbo.com/p/3", "koffie & thee", 200_002),
        ("dirk", "Appels"): (0.85, None, 0, "1 kg", None, "https://www.dirk.nl/p/3",
            "zuivel & kaas", 300_000),
        ("dirk", "Boter"): (1.99, 2.49, 1, None, "1 de Beste", "https://www.dirk.nl/p/4t",
            "zuivel & kaas", 300_001),
    }


def test_unit_from_title(spark):
    titles = {
        "Cola 6 x 330 ml": "6 x 330 ml",
        "Cola 1,5 liter": "1,5 liter",
        "Eieren 10 stuks": "10 stuks",
        "Peer per stuk": "per stuk",
        "Peer": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = df.select("i", pg.unit_from_title(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == list(titles.values())


def test_reference_lists(spark):
    mapped = category_map(spark)
    assert mapped.count() == 56
    assert mapped.select("canonical_category").distinct().count() == 19
    assert {r["supermarket"]: r["count"] for r in mapped.groupBy("supermarket").count().collect()} == {
        "ah": 27, "jumbo": 18, "dirk": 11,
    }
    paths = category_paths(spark)
    assert {r["supermarket"]: r["count"] for r in paths.groupBy("supermarket").count().collect()} == {
        "ah": 27, "jumbo": 18, "dirk": 72,
    }
    # Every listed category is mapped and the other way round.
    listed = paths.select("supermarket", "category").distinct()
    originals = mapped.select("supermarket", F.col("original_category").alias("category"))
    assert listed.exceptAll(originals).count() == 0
    assert originals.exceptAll(listed).count() == 0


def test_elements_hold_all_their_descendants(spark):
    """Price box, badge, unit and old price with elements of their own kind inside."""
    pages = {
        "ah": """<article data-testid="product-card"><a href="/producten/product/1" title="Bekijk Melk"></a>
<div data-testid="price-amount"><div>nu <div></div></div><span class="integer">1</span><span>x</span>
<span class="fractional">45</span></div><div data-testid="product-shield"><div></div><div>Bonus</div></div>
<span data-testid="price-was"><span>van</span> <span>1,99</span></span>
<span data-testid="product-unit-size"><span>per</span> 1 <span>l</span></span></article>""",
        "jumbo": """<article class="product-container"><a class="title-link" href="/p/2">Cola</a>
<div class="old-price"><div></div><span class="whole">4</span><span class="fractional">00</span></div>
<div class="current-price"><div>nu</div><span class="whole">3</span><span class="fractional">49</span></div>
</article>""",
        "dirk": """<article data-product-id="3"><a class="bottom" href="/p/3"><p class="title">Kaas</p>
<span class="subtitle"><span>1</span> kg</span></a><div class="logos"><div></div>
<img src="l" alt="1 de Beste"></div><div class="price-container"><div>nu</div><div class="price"><div></div>
<span class="hasEuros price-large">5</span><span class="price-small">25</span></div></div></article>""",
        "other": "<article><p>x</p></article>",
        None: "<article><p>x</p></article>",
    }
    rows = [(k, "u", store, html) for k, (store, html) in enumerate(pages.items())]
    rows.append((9, "u", "jumbo", JUMBO))
    df = spark.createDataFrame(rows, "page_seq long, url string, supermarket string, html string")
    df = df.withColumns({"captured_at": F.lit("2026-03-11 06:00:00").cast("timestamp_ntz"),
                         "category": F.lit("c")})
    got = {r.name: r for r in pg.extract_observations(df).collect()}
    assert (got["Melk"].price, got["Melk"].original_price, got["Melk"].is_sale) == (1.45, 1.99, 1)
    assert got["Melk"].unit == "per 1 l"
    assert (got["Cola"].price, got["Cola"].original_price) == (3.49, 4.0)
    assert (got["Kaas"].price, got["Kaas"].unit, got["Kaas"].brand) == (5.25, "1 kg", "1 de Beste")
    rejects = {(r.page_seq, r.card_pos, r.name, r.reason) for r in pg.rejected_cards(df).collect()}
    assert rejects == {(3, None, None, "unknown_store"), (4, None, None, "unknown_store"),
                       (9, 3, "Zonder prijs", "price_missing")}


def odd_pages():
    """Cards as a DOM sees them, where brackets in values, comments and cards inside cards mislead."""
    note = "<!-- </div></article> <span class='whole'>9</span> -->"
    promo = '<article class="promo"><div><p class="note">Nieuw</p></div></article>'
    script = '<script>if (a < b) { x = "</article>"; }</script>'
    return {
        "ah": f"""<article data-label="1 > 0" data-testid="product-card">{promo}{script}
<a href="/producten/product/1" title="Bekijk Melk > 1L"></a><div data-testid="price-amount">{note}
<span class="integer">1</span><span class="fractional">45</span></div>
<span data-testid="product-unit-size" data-x="a<b">1 l</span></article>
<article data-testid="product-card"><a href="/producten/product/2" title="Bekijk Kaas"></a>
<article data-testid="product-card"><a href="/producten/product/3" title="Bekijk Boter"></a>
<div data-testid="price-amount"><span class="integer">3</span><span class="fractional">00</span></div></article>
</article>""",
        "jumbo": f"""<article aria-label="x > y" class="product-container">{promo}{note}
<a title="2 > 1" class="title-link" href="/p/2">Cola {note}&gt; zero</a>{script}<div class="current-price">{note}
<span class="whole" data-v="<b>">3</span><span class="fractional">49</span></div></article>""",
        "dirk": f"""<article title="a>b" data-product-id="3">{promo}<a class="bottom" href="/p/3">
<p title="<p>" class="title">Peer{note}</p></a><div class="price-container">{note}<div class="price">{note}
<span class="hasEuros price-large">5</span><span class="price-small">25</span></div></div></article>""",
    }


def test_cards_are_read_as_tokens(spark):
    rows = [(k, "u", store, html) for k, (store, html) in enumerate(odd_pages().items())]
    df = spark.createDataFrame(rows, "page_seq long, url string, supermarket string, html string")
    df = df.withColumns({"captured_at": F.lit("2026-03-11 06:00:00").cast("timestamp_ntz"),
                         "category": F.lit("c")})
    got = {r.name: (r.price, r.unit, r.url, r.seq) for r in pg.extract_observations(df).collect()}
    site = {s: f"https://www.{s}.{'com' if s == 'jumbo' else 'nl'}" for s in ("ah", "jumbo", "dirk")}
    assert got == {
        "Melk > 1L": (1.45, "1 l", site["ah"] + "/producten/product/1", 0),
        # The outer card's first price box is that of the card inside it, as in a DOM.
        "Kaas": (3.0, None, site["ah"] + "/producten/product/2", 1),
        "Boter": (3.0, None, site["ah"] + "/producten/product/3", 2),
        "Cola > zero": (3.49, None, site["jumbo"] + "/p/2", 100_000),
        "Peer": (5.25, None, site["dirk"] + "/p/3", 200_000),
    }
    cards = pg.explode_cards(df.filter("supermarket = 'ah'"), "ah")
    assert [r.card_pos for r in cards.orderBy("card_pos").collect()] == [0, 1, 2]
    assert pg.explode_cards(df, None).count() == 4 + 2 + 2


def test_plain_tags(spark):
    texts = {
        '<a title="1 > 0">x</a>': '<a title="1 &gt; 0">x</a>',
        "a<!-- <b> -->c<!-- open <i>": "ac",
        '<p>1 < 2</p><style>p > a {}</style><script src="x">a < b': "<p>1 &lt; 2</p>",
        "plain <b>text</b>": "plain <b>text</b>",
        "": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.p for r in df.orderBy("i").select(pg.plain_tags(F.col("t")).alias("p")).collect()]
    assert got == list(texts.values())


def test_one_scan(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    df = spark.read.parquet(path).selectExpr(
        "page_id AS page_seq", "url", "'ah' AS supermarket", "html", "'c' AS category",
        "TIMESTAMP_NTZ'2026-03-11 06:00:00' AS captured_at",
    )
    plan = pg.extract_observations(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_parts_of_a_card_are_read_once(spark):
    """Unit, link and old euros are in the plan once, not once for each use of theirs."""
    pages = spark.createDataFrame([(1, "")], "page_seq long, html string")

    def plan(store):
        offers = pg.EXTRACTORS[store](pg.explode_cards(pages, store))
        return offers._jdf.queryExecution().optimizedPlan().toString()

    jumbo = plan("jumbo")
    assert jumbo.count('testid="jum') == 1
    assert jumbo.count("href=") == 1
    assert plan("dirk").count("hasEuros") == 2  # the tag of the price, the old euros
