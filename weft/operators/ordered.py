"""Orders, ranks and running sums that no single task has to hold.

A window over a whole table, or over a group that may hold a third of it, runs in one
task. Here rows are range-partitioned by group and order, summed within each range,
and each range adds what the ranges before it sum to; only one row for each group and
range is gathered for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint


#: Rows of a group up to which Spark limits groups before it shuffles them.
LIMITED = 1000


def met_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which nulls equal each other; the left keys stay."""
    if not on:  # the right side is one row of totals
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = [left[c].eqNullSafe(other[f"_on_{c}"]) for c in on]
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def running_sums(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """df with a column for each of `sums`: its sum over the group's rows up to this one.

    `order` has to be unique within the group.
    """
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = checkpoint(df.repartitionByRange(*group, *ordering).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *group).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    value = {k: F.col(c) if isinstance(c, str) else c for k, c in sums.items()}
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *group).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in value.items()])
    offsets = totals.select("_range", *[F.col(g).alias(f"_g_{g}") for g in group], *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in value])
    local = ranged.withColumns({k: F.sum(c).over(within) for k, c in value.items()})
    same = [local[g].eqNullSafe(offsets[f"_g_{g}"]) for g in group]
    met = local.join(offsets, [local["_range"] == offsets["_range"], *same])
    return met.select(*[local[c] for c in df.columns], *[(local[k] + F.col(f"_b_{k}")).alias(k) for k in value])


def row_numbers(df: DataFrame, group: list[str], order: list[Column | str], name: str = "row_number") -> DataFrame:
    return running_sums(df, group, order, {name: F.lit(1).cast("long")})


def equal_count_bins(df: DataFrame, order: list[Column | str], bins: int, name: str = "bin", group: list[str] | None = None) -> DataFrame:
    """Bins of equal counts by floor((rank - 1) * bins / n); unlike ntile, remainders spread over the bins."""
    group = group or []
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    numbered = row_numbers(df, group, order, "_rank")
    return met_on(numbered, n, group).select(*df.columns, F.floor((F.col("_rank") - 1) * bins / F.col("_n")).cast("long").alias(name))


def average_ranks(df: DataFrame, group: list[str], value: str, name: str = "rank", times: str | None = None) -> DataFrame:
    """Rank with ties given their mean rank; a null value has a null rank, rows of a null group rank among each other. `times` names a column of how many equal rows a row stands for."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n"))
    ends = running_sums(counts, group, [value], {"_end": "_n"})
    ranks = ends.select(*group, value, (F.col("_end") - (F.col("_n") - 1) / 2.0).alias(name))
    return met_on(df, ranks, [*group, value], "left")


def top_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group. Up to LIMITED rows, every partition keeps its own first n of a group before the shuffle; more are numbered by ranges."""
    if n > LIMITED:
        return row_numbers(df, group, order, name).where(F.col(name) <= n)
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*ordering)).cast("long")).where(F.col(name) <= n)


def best_row(df: DataFrame, group: list[str], best: Column, *others: str) -> DataFrame:
    """For each group the columns `others` of the row whose `best` (a struct with a unique last part) is largest; combines before the shuffle."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*others), best).alias("_b")).select(*group, "_b.*")


def least_row(df: DataFrame, group: list[str], least: Column, *others: str) -> DataFrame:
    return df.groupBy(*group).agg(F.min_by(F.struct(*others), least).alias("_b")).select(*group, "_b.*")


def adjusted_p(df: DataFrame, group: list[str], p: str, ident: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg; null p stay null.

    The reverse cumulative minimum is a minimum over ranks from this one on: within a
    range a window gives it, and ranges after this one add theirs.
    """
    has = df.where(F.col(p).isNotNull())
    n = has.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_numbers(has, group, [p, ident], "_k")
    raw = met_on(ranked, n, group).withColumn("_raw", F.col(p) * F.col("_n") / F.col("_k"))
    ranged = checkpoint(raw.repartitionByRange(*group, "_k").withColumn("_range", F.spark_partition_id()))
    later = Window.partitionBy(*group).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    floor = ranged.groupBy("_range", *group).agg(F.min("_raw").alias("_m")).select("_range", *[F.col(g).alias(f"_g_{g}") for g in group], F.min("_m").over(later).alias("_later"))
    local = ranged.withColumn("_own", F.min("_raw").over(Window.partitionBy("_range", *group).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)))
    met = local.join(floor, [local["_range"] == floor["_range"], *[local[g].eqNullSafe(floor[f"_g_{g}"]) for g in group]])
    out = met.select(*[local[c] for c in df.columns], F.least(F.lit(1.0), "_own", F.coalesce("_later", F.lit(1.0))).alias(name))
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def running_max_before(df: DataFrame, group: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the largest `value` of the group's earlier rows (null for the first); `order` is unique within the group."""
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = checkpoint(df.repartitionByRange(*group, *ordering).withColumn("_range", F.spark_partition_id()))
    tops = ranged.groupBy("_range", *group).agg(F.max(value).alias("_top"))
    earlier = tops.withColumn("_earlier", F.max("_top").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    local = ranged.withColumn("_own", F.max(value).over(Window.partitionBy("_range", *group).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)))
    return met_on(local, earlier, ["_range", *group]).select(*df.columns, F.greatest("_own", "_earlier").alias(name))
