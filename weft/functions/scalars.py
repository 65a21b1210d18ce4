"""Scalar expressions: classes, coercions, delimited cells, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_boolean(c: Column) -> Column:
    """Text to Boolean: true, 1 and yes in any case."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def as_number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def reasons(**when: Column) -> Column:
    """Names of the conditions that hold, joined by ';' in the order given."""
    return F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in when.items()])


def first_match(default: str, **when: Column) -> Column:
    """The name of the first condition that holds."""
    out = F
    for name, c in when.items():
        out = out.when(c, F.lit(name))
    return out.otherwise(default)


def capped_count(n: Column, most: int) -> Column:
    """'1', '2', ... and '<most>+' from there on."""
    return F.when(n >= most, F.lit(f"{most}+")).otherwise(n.cast("long").cast("string"))


def delimited_sum(c: Column, sep: str = ",") -> Column:
    """Sum of the numbers in a delimited cell; parts that are none count zero."""
    return F.aggregate(F.split(c, sep), F.lit(0.0), lambda a, x: a + F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)))


def joined_set(c: Column, sep: str = ";") -> Column:
    """Aggregate: distinct values in order, joined."""
    return F.array_join(F.sort_array(F.collect_set(c)), sep)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets held as arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def first_largest(**columns: Column) -> Column:
    """The name of the largest column, the first of equal ones."""
    top = F.greatest(*columns.values())
    return first_match(list(columns)[-1], **{k: c == top for k, c in list(columns.items())[:-1]})


def equal_width_bin(x: Column, bins: int) -> Column:
    """Bin 0..bins-1 of a number in [0, 1]; 1 falls in the last."""
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("long")


def contains_any(c: Column, tokens: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower(c), t))
