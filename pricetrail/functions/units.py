"""Pack sizes: from free text such as "6 x 330 ml" to a quantity in g, ml or pieces."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetrail.functions.text import clean_text, missing, once

# Unit spellings by unit.
UNIT_SPELLINGS = {
    "g": ("g", "gr", "gram"),
    "kg": ("kg", "kilo"),
    "ml": ("ml",),
    "cl": ("cl",),
    "l": ("l", "liter", "lt"),
    "stuk": ("stuk", "stuks", "st"),
}

# Base unit and factor by unit.
BASE_UNITS = {
    "g": ("g", 1.0),
    "kg": ("g", 1000.0),
    "ml": ("ml", 1.0),
    "cl": ("ml", 10.0),
    "l": ("ml", 1000.0),
    "stuk": ("stuk", 1.0),
}

# Words sold by the piece, and words that rule out a measurable size.
PIECE_WORDS = ("stuk", "bos", "bosje", "paar", "set", "rol", "pakket")
UNMEASURED_WORDS = ("wasbeurten", "rollen", "meter", "tabletten", "capsules", "cups")

_WORDS = "|".join(word for words in UNIT_SPELLINGS.values() for word in words)
_NUMBER = r"[\d.,]+"

# Storage and advertising notes around the size, as the stores print them.
_NOTE_BEFORE = (
    r"(?i)^(?:\d+\+?\s*dagen?\s*houdbaar\s*•\s*)?(?:Diepvries\s*•\s*)?(?:Gesponsord\s*•\s*)?"
)
_NOTE_AFTER = r"(?i)(?:,\s*verpakt)?(?:\s*•\s*(?:met|zonder)\s+\w+)?\z"
_PIECES_NOTE = r"(?is)^(.*?)\s*\(ca\.\s*\d+\s*stuks?\)"

# Each of the notes holds one of these; a text without them stays as it is.
_NOTE_SIGN = "[•,(]"

_PIECE = rf"(?i)^per\s+(?:{'|'.join(PIECE_WORDS)})\z"
_UNMEASURED = rf"(?i){'|'.join(UNMEASURED_WORDS)}"
_SIZES = "|".join(
    (
        # "6 x 330 ml", "4 x 6 x 330 ml": pack counts, then a size; text may follow.
        rf"(\d+)\s*x\s*(?:(\d+)\s*x\s*)?({_NUMBER})\s*({_WORDS})(?!\w)",
        # "500 g", "ca. 1,5 l.": one size and nothing after it.
        rf"(?:ca\.?\s*)?({_NUMBER})\s*({_WORDS})(?!\w)\.?\z",
        rf"per\s+({_NUMBER})\s*(kilo)\z",
        # "los per 500 g": loose goods; text may follow.
        rf"los\s+per\s+({_NUMBER})\s*(g|kg|ml|l)(?!\w)",
    )
)
# A size as count, inner count, number and unit; groups of the other forms are empty.
_SIZE_PATTERN = rf"(?is)^(?:{_SIZES}).*\z"
_SEPARATOR = "\u0001"
_SIZE_PARTS = _SEPARATOR.join(("$1", "$2", "$3$5$7$9", "$4$6$8$10"))


def parse_decimal(text: Column) -> Column:
    """Leading positive number of a text; its first comma counts as a decimal point."""
    dotted = F.when(F.contains(text, F.lit(",")), F.regexp_replace(text, r"^([^,]*),", "$1."))
    digits = F.regexp_extract(F.coalesce(dotted, text), r"^(\d+\.?\d*|\.\d+)", 1)
    # Digits and a point are never negative; an empty text is no number. The text is read once.
    return F.nullif(digits.try_cast("double"), F.lit(0.0))


def _lookup(values: dict[str, Column]) -> Column:
    return F.create_map(*(entry for key, value in values.items() for entry in (F.lit(key), value)))


def unit_name(text: Column) -> Column:
    """Unit behind a spelling ("liter" -> "l"), NULL if unknown."""
    word = F.regexp_replace(F.lower(text), r"\.\z", "")
    names = {
        spelling: F.lit(unit) for unit, words in UNIT_SPELLINGS.items() for spelling in words
    }
    return F.try_element_at(_lookup(names), word)


def base_kind(unit: Column) -> Column:
    return F.try_element_at(_lookup({u: F.lit(kind) for u, (kind, _) in BASE_UNITS.items()}), unit)


def base_factor(unit: Column) -> Column:
    return F.try_element_at(_lookup({u: F.lit(by) for u, (_, by) in BASE_UNITS.items()}), unit)


def to_base_unit(qty: Column, unit: Column) -> Column:
    """Quantity of a unit as struct<qty, type> in g, ml or stuk; NULL if either is unknown."""
    size = F.struct((qty * base_factor(unit)).alias("qty"), base_kind(unit).alias("type"))
    return F.when(qty.isNotNull() & base_kind(unit).isNotNull(), size)


def without_notes(cleaned: Column) -> Column:
    """A size text in plain spaces without the notes stores print around it."""
    bare = F.regexp_replace(F.regexp_replace(cleaned, _NOTE_BEFORE, ""), _NOTE_AFTER, "")
    bare = F.trim(F.regexp_replace(bare, _PIECES_NOTE, "$1"))
    return F.when(cleaned.rlike(_NOTE_SIGN), bare).otherwise(cleaned)


def clean_unit(text: Column) -> Column:
    """Size text without the notes stores print around it."""
    return once(clean_text(text), without_notes)


def size_parts(text: Column) -> Column:
    """Array of count, inner count, number and unit; NULL where there is no size."""
    parts = F.split(F.regexp_replace(text, _SIZE_PATTERN, _SIZE_PARTS), _SEPARATOR)
    return F.when(text.rlike(_SIZE_PATTERN), parts)


def part(parts: Column, index: int) -> Column:
    """One of the size parts, NULL where it is absent."""
    return F.nullif(F.get(parts, F.lit(index)), F.lit(""))


def is_piece(text: Column) -> Column:
    return text.rlike(_PIECE)


def is_measured(text: Column, parts: Column, number: Column, unit: Column) -> Column:
    """A valid number and unit, unless the text names goods that are not sold by measure."""
    # Packs of packs hold weights or volumes, never pieces.
    counted_pieces = part(parts, 1).isNotNull() & (unit == "stuk")
    known = number.isNotNull() & unit.isNotNull()
    return known & ~counted_pieces & ~text.rlike(_UNMEASURED)


def pack_quantity(parts: Column, number: Column, unit: Column) -> Column:
    def times(index: int) -> Column:
        return F.coalesce(part(parts, index).cast("double"), F.lit(1.0))

    return times(0) * times(1) * (number * base_factor(unit))


def parse_unit(text: Column) -> Column:
    """struct<qty double, type string> of a free-text pack size, NULL when not measurable."""

    def named(cleaned: Column, parts: Column, read: Column) -> Column:
        number, unit = read["number"], read["unit"]
        size = F.struct(
            pack_quantity(parts, number, unit).alias("qty"), base_kind(unit).alias("type")
        )
        return F.when(is_measured(cleaned, parts, number, unit), size)

    def measured(cleaned: Column, parts: Column) -> Column:
        read = F.struct(
            parse_decimal(part(parts, 2)).alias("number"), unit_name(part(parts, 3)).alias("unit")
        )
        return once(read, lambda it: named(cleaned, parts, it))

    def size(cleaned: Column) -> Column:
        piece = F.struct(F.lit(1.0).alias("qty"), F.lit("stuk").alias("type"))
        sized = once(size_parts(cleaned), lambda parts: measured(cleaned, parts))
        return F.when(is_piece(cleaned), piece).otherwise(sized)

    return once(clean_unit(text), size)


def price_per_unit(price: Column, qty: Column, kind: Column) -> Column:
    """Price per kg, per litre or per piece."""
    each = F.when((price != 0) & (qty > 0), price / qty)
    return F.when(kind.isin("g", "ml"), each * 1000.0).when(kind == "stuk", each)


def units_compatible(a: Column, b: Column) -> Column:
    """True unless both unit types are known and differ."""
    return missing(a) | missing(b) | (a == b)
