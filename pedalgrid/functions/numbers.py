"""Numeric guards, rounding, ratios and weighted means."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the registry's "no information" marker, which is not NULL.
NO_INFORMATION = "s_i"
# Fixed value: surveyed trips a zone needs before its figure is shown.
LEAST_SURVEYED = 5
# sums of the same numbers in another order differ by less than this part of them
NOISE = 1e-12


def safe_double(c: Column) -> Column:
    """Text or number to a finite double; anything else becomes NULL."""
    return finite(c.cast("string").try_cast("double"))


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def half_even(c: Column, digits: int = 0) -> Column:
    """Half-even rounding of the decimal value.

    What lies within rounding noise of a half is one: a sum that ends in 5 must not
    flip with the order in which partitions were added. Noise is a part of the value,
    so a measured figure a millionth above a half is still rounded up.
    """
    scaled = F.abs(c.cast("double") * 10.0**digits)
    at_half = F.abs(scaled % 1.0 - 0.5) <= scaled * NOISE
    return F.when(at_half, F.bround(F.round(c, digits + 4), digits)).otherwise(F.bround(c, digits))


def json_number(c: Column, digits: int = 2) -> Column:
    return half_even(finite(c.cast("double")), digits)


def guard_range(c: Column, over: float, upto: float) -> Column:
    """Keep ``over < c <= upto``, else NULL."""
    return F.when((c > over) & (c <= upto), c)


def ratio(num: Column, den: Column, scale: float = 100.0) -> Column:
    """``scale * num / den`` with a zero denominator read as unknown."""
    return F.lit(scale) * num / F.nullif(den.cast("double"), F.lit(0.0))


def total(c: Column) -> Column:
    """Sum in which nothing to add is 0."""
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


def total_if(cond: Column, c: Column) -> Column:
    return total(F.when(F.coalesce(cond, F.lit(False)), c))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def weighted_mean(x: Column, w: Column, strict: bool = False, else_plain: bool = False) -> Column:
    """Mean of ``x`` weighted by ``w`` over the group.

    Rows without ``x`` leave the denominator too; ``strict`` gives NULL as soon
    as one of them exists. ``else_plain`` falls back to the plain mean where
    the weights add up to nothing.
    """
    den = F.sum(F.when(x.isNotNull(), w))
    mean = F.when(den > 0, F.sum(x * w) / den)
    if else_plain:
        mean = F.coalesce(mean, F.when(F.coalesce(den, F.lit(0.0)) <= 0, F.avg(x)))
    if strict:
        mean = F.when(F.count(F.when(x.isNull(), F.lit(1))) == 0, mean)
    return mean


def is_informed(c: Column) -> Column:
    """Neither NULL nor the no-information marker."""
    return F.coalesce(c.cast("string") != NO_INFORMATION, F.lit(False))


def support_status(n: Column, least: float = LEAST_SURVEYED) -> Column:
    """Tell "no survey here" from "surveyed, but too little"."""
    return F.when(n.isNull(), "no_data").when(n < least, "insufficient").otherwise("ok")


def per_thousand(value: Column, people: Column) -> Column:
    return ratio(value, people, 1000.0)


def lesser_known(a: Column, b: Column) -> Column:
    """Smaller of two, unknown when either is (``least`` would skip NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
