"""Column functions. All are built from Spark SQL expressions; none runs Python per row."""

from pricetrail.functions.numeric import (
    exact_mean,
    moment_key,
    pct_change,
    round_half,
    round_up_half,
)
from pricetrail.functions.text import (
    ascii_lower,
    clean_text,
    contains_term,
    missing,
    normalize_name,
    slugify,
    strip_trailing_unit,
    within_distance,
)
from pricetrail.functions.units import (
    parse_decimal,
    parse_unit,
    price_per_unit,
    to_base_unit,
    unit_name,
    units_compatible,
)

__all__ = [
    "ascii_lower",
    "clean_text",
    "contains_term",
    "exact_mean",
    "missing",
    "moment_key",
    "normalize_name",
    "parse_decimal",
    "parse_unit",
    "pct_change",
    "price_per_unit",
    "round_half",
    "round_up_half",
    "slugify",
    "strip_trailing_unit",
    "to_base_unit",
    "unit_name",
    "units_compatible",
    "within_distance",
]
