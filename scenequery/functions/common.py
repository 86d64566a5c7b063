"""Small column expressions used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: Column | str) -> Column:
    """A number to six decimals, half to even on its exact binary value; null, NaN, infinities and numbers from 4e9 on, which have no further digits to lose or few, as they are. Small negative numbers become -0.0.

    The product with a million is off by what two exact products of its halves tell, which decides where it falls on a half.
    """
    million = 1e6

    def nearest(v: Column) -> Column:
        upper = v * 134217729.0 - (v * 134217729.0 - v)
        product = v * million
        beyond = (upper * million - product) + (v - upper) * million
        whole = F.rint(product)
        off = product - whole
        near = F.when((off == 0.5) & (beyond > 0), whole + 1.0).when((off == -0.5) & (beyond < 0), whole - 1.0).otherwise(whole)  # a sum would lose the sign of zero
        return F.when(F.abs(v) < 4e9, near / million).otherwise(v)

    return F.get(F.transform(F.array(col(x).cast("double")), nearest), 0)


def rounded_away(x: Column | str) -> Column:
    """A number to six decimals, halves of its product with a million away from zero, as SQL's round has them; else as rounded()."""
    million = 1e6

    def nearest(v: Column) -> Column:
        product = v * million
        whole = F.rint(product)
        off = product - whole
        near = F.when((off == 0.5) & (product > 0), whole + 1.0).when((off == -0.5) & (product < 0), whole - 1.0).otherwise(whole)
        return F.when(F.abs(product) < float("inf"), near / million).otherwise(v)

    return F.get(F.transform(F.array(col(x).cast("double")), nearest), 0)


def rounded_up(x: Column | str, digits: int) -> Column:
    """A number to some decimals, halves of its decimal text away from zero; small negative numbers and -0.0 are -0.0, which round() makes 0.0."""
    v = col(x).cast("double")
    near = F.round(v, digits)
    return F.when(near == 0, v * 0.0).otherwise(near)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share rounded to six digits; 0 where there is nothing to divide by."""
    return F.coalesce(rounded(F.try_divide(numerator, denominator)), F.lit(0.0))


def finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nullif_zero(x: Column) -> Column:
    """Zero counts as missing."""
    return F.when(x != 0, x)


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def ordered_list(order: str, value: Column | str) -> Column:
    """Values of a group in the order of a unique column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), col(value).alias("v")))), lambda s: s["v"])


def stem(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^.]*$", "")


def clean_text(value: Column | str) -> Column:
    """Trimmed lower-case text, empty for null."""
    return F.lower(F.trim(F.coalesce(col(value), F.lit(""))))


def key_text(value: Column | str) -> Column:
    """A grouping key; null is the group None."""
    return F.coalesce(col(value), F.lit("None"))


def json_safe(x: Column | str) -> Column:
    """NaN and infinities become null, as JSON has none."""
    x = col(x)
    return F.when(finite(x), x)


def slash_path(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def merged(left: Column | str, right: Column | str) -> Column:
    """Two maps as one; where both have a key, the right one's value counts."""
    a, b = col(left), col(right)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)
