"""Names, search terms and slugs."""

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters web pages use as white space. Java's \s covers ASCII only.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# The same characters as a regex class, by ranges: a character outside is told in few steps.
SPACE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# House-brand prefixes, the first one that fits is removed.
BRAND_PREFIXES = (
    "AH Biologisch ",
    "AH Biologische ",
    "AH Terra Plant Based ",
    "AH Excellent ",
    "AH Basic ",
    "AH ",
    "Jumbo Biologische ",
    "Jumbo Biologisch ",
    "Jumbo ",
    "1 de Beste ",
)

# Unit words that may end a product name.
NAME_UNITS = ("g", "gr", "gram", "kg", "ml", "cl", "l", "liter", "stuks", "stuk")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: as an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column) -> Column:
    """Turn every kind of white space into a plain space and trim both ends."""
    return F.trim(F.translate(text, SPACES, " " * len(SPACES)))


def trim_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def missing(text: Column) -> Column:
    """True for NULL and for the empty string."""
    return text.isNull() | (text == "")


def normalize_name(name: Column) -> Column:
    """Product name without house-brand prefix, in lower case."""
    prefix = "^(?:" + "|".join(BRAND_PREFIXES) + ")"
    return trim_spaces(F.lower(F.regexp_replace(trim_spaces(name), prefix, "")))


def strip_trailing_unit(name: Column) -> Column:
    """Drop a pack size at the end of a name: "melk 1,5 l" -> "melk"."""
    # Most places hold a printed ASCII character, which is no space: the look ahead rules them out at once.
    size = rf"(?i)(?![!-~]){SPACE}+\d+[\d.,]*{SPACE}*(?:{'|'.join(NAME_UNITS)}){SPACE}*\z"
    return trim_spaces(F.regexp_replace(name, size, ""))


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, the folding used by term search."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_term(text: Column, term: str) -> Column:
    """Case-insensitive (ASCII) "contains"; % and _ in the term are wildcards."""
    folded = term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return ascii_lower(text).like("%" + folded.replace("\\", "\\\\") + "%")


def within_distance(a: Column, b: Column, limit: Column | int) -> Column:
    """Edit distance of two texts when it is at most `limit` (0 to 3), else NULL."""
    distance = F.levenshtein(a, b, 3)
    return F.when((distance >= 0) & (distance <= limit), distance)
