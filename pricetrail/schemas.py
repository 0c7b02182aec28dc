"""Table schemas and the fixed values every operator shares."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_long, _int, _text, _real, _time = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)

OBSERVATIONS = _schema(
    seq=_long, scraped_at=_time, supermarket=_text, category=_text, name=_text, brand=_text,
    unit=_text, url=_text, price=_real, original_price=_real, is_sale=_int,
)

PRODUCTS = _schema(
    id=_long, name=_text, brand=_text, category=_text, unit=_text, supermarket=_text, url=_text,
    created_at=_time, normalized_name=_text, unit_quantity=_real, unit_type=_text,
    price_per_unit=_real,
)

# Columns of PRODUCTS that older stored catalogs may lack.
DERIVED_PRODUCT_COLUMNS = ("normalized_name", "unit_quantity", "unit_type", "price_per_unit")

PRICES = _schema(
    id=_long, product_id=_long, price=_real, original_price=_real, is_sale=_int, scraped_at=_time,
)

CATEGORY_MAP = _schema(canonical_category=_text, supermarket=_text, original_category=_text)

MATCHES = _schema(
    id=_long, canonical_name=_text, match_type=_text, confidence=_real, confirmed=_int,
    created_at=_time,
)

MATCH_MEMBERS = _schema(match_id=_long, product_id=_long)

UNIT_CHANGES = _schema(
    id=_long, product_id=_long, old_unit=_text, new_unit=_text, detected_at=_time,
)

DECISIONS = T.StructType(
    [T.StructField("match_id", _long, True), T.StructField("confirmed", T.BooleanType(), True)]
)

PAGES = _schema(
    page_seq=_long, url=_text, supermarket=_text, category=_text, captured_at=_time, html=_text,
)

# Store codes in matching order (the first one is the base of fuzzy matching),
# display names and site addresses.
STORES = ("ah", "jumbo", "dirk")
STORE_NAMES = {"ah": "Albert Heijn", "jumbo": "Jumbo", "dirk": "Dirk"}
STORE_SITES = {
    "ah": "https://www.ah.nl",
    "jumbo": "https://www.jumbo.com",
    "dirk": "https://www.dirk.nl",
}

# Accepted price range (0, MAX_PRICE] and the relative jump worth a warning.
MAX_PRICE = 500.0
MAX_JUMP = 0.5
