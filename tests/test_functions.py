import re

import pytest
from pyspark.sql import functions as F

from pricetrail import functions as fn
from pricetrail.functions import units
from pricetrail.functions.text import SPACE, SPACES

UNITS = {
    "500 g": (500.0, "g"),
    "1,5 L": (1500.0, "ml"),
    "75 cl": (750.0, "ml"),
    "6 x 330 ml": (1980.0, "ml"),
    "6 x 330 ml. tray": (1980.0, "ml"),
    "4 x 6 x 330 ml": (7920.0, "ml"),
    "4 x 6 x 3 stuks": None,
    "6 x 4 stuks": (24.0, "stuk"),
    "per stuk": (1.0, "stuk"),
    "Per bos": (1.0, "stuk"),
    "per pakket": (1.0, "stuk"),
    "Per 1,5 kilo": (1500.0, "g"),
    "per 1 kilo.": None,
    "per 500 g": None,
    "1 kg (ca. 10 stuks)": (1000.0, "g"),
    "1 kg (ca. 10 stuks) (ca. 5 stuks)": None,
    "ca. 100 g": (100.0, "g"),
    "ca 100 g.": (100.0, "g"),
    "4 stuks": (4.0, "stuk"),
    "4 st": (4.0, "stuk"),
    "4+ dagen houdbaar • 1 L": (1000.0, "ml"),
    "3 dagen houdbaar": None,
    "Diepvries • 450 g": (450.0, "g"),
    "2+ dagen houdbaar • Diepvries • Gesponsord • 450 g": (450.0, "g"),
    "Gesponsord • Diepvries • 450 g": None,
    "500 g • Met doos": (500.0, "g"),
    "500 g, verpakt": (500.0, "g"),
    "500 g, verpakt • Zonder doos": (500.0, "g"),
    "500 g • Zonder doos, verpakt": None,
    "500 g": (500.0, "g"),
    " 500 g　": (500.0, "g"),
    "los per 500 g": (500.0, "g"),
    "los per 2 kg bak": (2000.0, "g"),
    "1.500 g": (1.5, "g"),
    "1,5,0 kg": (1500.0, "g"),
    ". g": None,
    "6 x . g": None,
    "0 x 5 g": (0.0, "g"),
    "1+ dag houdbaar • 150 g": None,
    "20 wasbeurten": None,
    "500 g cups": None,
    "6 x 20 ml cups": None,
    "2-3 pers": None,
    "Diepvries": None,
    "5m x 6cm": None,
    "0 g": None,
    "500 gé": (500.0, "g"),
    "500 grammen": None,
    "": None,
    "  ": None,
    None: None,
}


def column(spark, values, expression, kind="string"):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression.alias("r"))
    return [row.r for row in sorted(df.collect(), key=lambda row: row.i)]


def test_parse_unit(spark):
    got = column(spark, list(UNITS), fn.parse_unit(F.col("v")))
    cases = {
        text: None if r is None else (r.qty, r.type) for text, r in zip(UNITS, got, strict=True)
    }
    # A letter outside ASCII ends a word, then the size is no longer at the end of the text.
    expected = UNITS | {"500 gé": None}
    assert cases == expected


@pytest.mark.parametrize(
    "text,expected",
    [("1,5", 1.5), ("1.500", 1.5), ("1,5,0", 1.5), (".5", 0.5), ("5.", 5.0), (".", None),
     ("0", None), ("", None), (None, None), ("12a", 12.0)],
)
def test_parse_decimal(spark, text, expected):
    assert column(spark, [text], fn.parse_decimal(F.col("v"))) == [expected]


def test_unit_names_and_base_units(spark):
    names = ["G", "gr", "gram", "KG", "kilo", "ml", "cl", "L", "liter", "lt", "st", "stuks", "x"]
    assert column(spark, names, fn.unit_name(F.col("v"))) == [
        "g", "g", "g", "kg", "kg", "ml", "cl", "l", "l", "l", "stuk", "stuk", None,
    ]
    base = column(spark, ["g", "kg", "cl", "l", "stuk", "x"], fn.to_base_unit(F.lit(2.0), F.col("v")))
    assert [b and (b.qty, b.type) for b in base] == [
        (2.0, "g"), (2000.0, "g"), (20.0, "ml"), (2000.0, "ml"), (2.0, "stuk"), None,
    ]


def test_names(spark):
    names = {
        "AH Biologisch Volle melk": "volle melk",
        "AH Biologische Volle melk": "volle melk",
        "AH Terra Plant Based Burger": "burger",
        "Jumbo Volle Melk 1 L": "volle melk 1 l",
        "1 de Beste Boter": "boter",
        "ah melk": "ah melk",
        " AH Jumbo Kaas ": "jumbo kaas",
        "AH": "ah",
    }
    assert column(spark, list(names), fn.normalize_name(F.col("v"))) == list(names.values())
    stripped = {
        "volle melk 1 l": "volle melk",
        "aroma rood 500g": "aroma rood",
        "sap 1,5 liter ": "sap",
        "eieren 6 stuks": "eieren",
        "eieren 6 st": "eieren 6 st",
        "melk": "melk",
        "500 g": "500 g",
        "cola 6 x 330 ml": "cola 6 x",
    }
    assert column(spark, list(stripped), fn.strip_trailing_unit(F.col("v"))) == list(
        stripped.values()
    )
    slugs = {"Kaas & Vleeswaren": "kaas-vleeswaren", "--Één--": "n", "a.b": "a-b", "": ""}
    assert column(spark, list(slugs), fn.slugify(F.col("v"))) == list(slugs.values())


def test_search_terms(spark):
    values = ["AH Melk", "ah MELK", "Éclair", "100% sap", "a\\b", None]

    def found(term):
        return column(spark, values, fn.contains_term(F.col("v"), term))

    assert found("melk") == [True, True, False, False, False, None]
    assert found("éclair") == [False] * 5 + [None]
    assert found("É") == [False, False, True, False, False, None]
    assert found("a_ m") == [True, True, False, False, False, None]
    assert found("\\B") == [False, False, False, False, True, None]


def test_rounding(spark):
    def r(values, digits):
        return column(spark, values, fn.round_half(F.col("v"), digits), "double")

    assert r([0.5, -0.5, 2.5, -0.001, 79.96], 0) == [1.0, -1.0, 3.0, 0.0, 80.0]
    assert r([79.96, 79.94, None], 1) == [80.0, 79.9, None]
    assert column(spark, [2.5, -2.5, -0.4], fn.round_up_half(F.col("v")), "double") == [3, -2, 0]
    assert column(spark, [0.0, 2.0], fn.pct_change(F.col("v"), F.lit(3.0)), "double") == [None, 50.0]


def test_price_per_unit(spark):
    rows = [
        (1.39, 1000.0, "ml"), (3.0, 500.0, "g"), (3.0, 2.0, "stuk"), (0.0, 2.0, "g"),
        (None, 2.0, "g"), (1.0, 0.0, "g"), (1.0, None, "g"), (1.0, 2.0, None),
    ]
    df = spark.createDataFrame(rows, "p double, q double, t string")
    got = [r[0] for r in df.select(fn.price_per_unit(F.col("p"), F.col("q"), F.col("t"))).collect()]
    assert got[0] == pytest.approx(1.39)
    assert got[1:] == [6.0, 1.5, None, None, None, None, None]


def test_unit_compatibility_and_distance(spark):
    df = spark.createDataFrame([("g", "g"), ("g", "ml"), (None, "g"), ("", "g")], "a string, b string")
    got = [r[0] for r in df.select(fn.units_compatible(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, True]
    pairs = [("melk", "melk"), ("melk", "melks"), ("melk", "kaas"), ("abcdef", "ghijkl")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(fn.within_distance(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [0, 1, None, None]


def test_space_class_holds_the_space_characters():
    held = {chr(k) for k in range(0x10000) if re.fullmatch(SPACE, chr(k))}
    assert held == set(SPACES)


def test_numbers_and_notes(spark):
    texts = {"1,5": 1.5, ".5": 0.5, "1.": 1.0, "1,2,3": 1.2, "0": None, "0,0": None, "": None, ",5": 0.5,
             "abc": None, None: None, "1.2.3": 1.2}
    notes = {"2+ dagen houdbaar • 500 g": "500 g", "1,5 L, verpakt": "1,5 L", "1 kg (ca. 10 stuks)": "1 kg",
             "500\u00a0g ": "500 g", "6 x 1,5 l • met prik": "6 x 1,5 l", "per stuk": "per stuk", None: None,
             "": ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", units.parse_decimal(F.col("t")).alias("n")).collect()} == texts
    df = spark.createDataFrame([(t,) for t in notes], "t string")
    assert {r.t: r.n for r in df.select("t", units.clean_unit(F.col("t")).alias("n")).collect()} == notes
