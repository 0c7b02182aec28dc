"""Rounding and ratios with the number semantics the reports rely on."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(x: Column, digits: int) -> Column:
    """Round half away from zero on doubles (Spark's round() goes through decimals)."""
    scale = 10.0**digits
    # Adding 0.0 turns -0.0 into 0.0.
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + 0.0


def round_up_half(x: Column) -> Column:
    """Round to a whole number, halves upwards: 2.5 -> 3, -2.5 -> -2."""
    return F.floor(x + 0.5)


def pct_change(first: Column, last: Column) -> Column:
    """Relative change in percent; NULL when the first value is not positive."""
    return F.when(first > 0, (last - first) / first * 100.0)


def moment_key(time: Column, id_: Column) -> Column:
    """Time, then id, as one number of fixed width, for aggregates that keep the first or last row."""
    micros = F.unix_micros(time.cast("timestamp")).cast("decimal(20,0)")
    # An id has at most 19 digits.
    return micros * F.lit(Decimal(10**19)) + id_.cast("decimal(19,0)")


def exact_mean(x: Column) -> Column:
    """Mean of amounts to ten decimals, independent of the order of summation.

    A mean of doubles depends on how rows are spread over tasks; a decimal sum does not, so a
    retried or re-partitioned job gives the same published figure.
    """
    return F.sum(x.cast("decimal(28,10)")).cast("double") / F.count(x)
