"""Joins by the size of what is joined."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def join_large(df: DataFrame, other: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow, always by shuffle.

    Spark judges a table by its files: a few MB of them can hold rows that take GBs once they are decoded,
    exploded or padded with text, and a broadcast sends all of that through the driver.
    """
    return df.join(other.hint("merge"), on, how)


def join_counted(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Join with a table that is cheap to read: by shuffle unless a bounded count shows it is small."""
    if other.limit(MAX_BROADCAST_ROWS + 1).count() > MAX_BROADCAST_ROWS:
        return join_large(df, other, on)
    return df.join(other, on)


def join_small(
    df: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Join with a lookup table: broadcast if a bounded count shows it is small, else by shuffle."""
    is_small = small.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(small) if is_small else small, on, how)
