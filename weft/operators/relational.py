"""Joins that check themselves, staged matching, set gates, reshaping."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.ordered import top_per_group

#: Rows of one side of a bin that meet the other side's in one call, pairs in a batch of what is handed on.
SIDE, PAIRS = 1 << 15, 1 << 14


class CardinalityError(ValueError):
    """A side that had to be unique in its key is not, or a row found no partner."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, on: Sequence[str], side: str = "table") -> DataFrame:
    """df, after a look for one repeated key."""
    twice = df.groupBy(*on).count().where("count > 1").limit(1).collect()
    if twice:
        raise CardinalityError(f"{side} repeats the key {tuple(twice[0])[:-1]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one", require_match: bool = False) -> DataFrame:
    """A join that fails if a side that is to be unique repeats a key, or, with require_match, if a left row has no partner."""
    if validate in ("one_to_one", "one_to_many"):
        require_unique(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        require_unique(right, on, "right")
    if require_match:
        lost = left.join(right.select(*on), list(on), "left_anti").limit(1).collect()
        if lost:
            raise CardinalityError(f"no partner for {tuple(lost[0][c] for c in on)}")
    return left.join(right, list(on), how)


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def outer_diff(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full join with a presence flag and, for each value column, whether the sides differ (nulls equal)."""
    a = left.select(*on, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(True).alias("_l"))
    b = right.select(*on, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(True).alias("_r"))
    both = a.join(b, list(on), "full")
    where = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return both.select(*on, where.alias("presence"), *[(~F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right"))).alias(f"{v}_differs") for v in values])


def complete_pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], measure: str) -> DataFrame:
    """Long to wide with one column for each of `values`, which every index has to have."""
    wide = df.groupBy(*index).pivot(column, list(values)).agg(F.max(measure))
    holes = wide.where(" OR ".join(f"`{v}` IS NULL" for v in values)).limit(1).collect()
    if holes:
        raise ValueError(f"the pivot has a hole at {tuple(holes[0][c] for c in index)}")
    return wide


def crosstab(df: DataFrame, index: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(index).pivot(column, list(values)).count().na.fill(0)


def zero_filled(left: DataFrame, right: DataFrame, counts: DataFrame, on: Sequence[str], measure: str) -> DataFrame:
    """Every pair of two small dimensions with its count, zero where there is none."""
    return left.join(right, how="cross").join(counts, list(on), "left").na.fill({measure: 0})


def missing_keys(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return expected.exceptAll(observed.select(*expected.columns))


def alias_resolution(wanted: DataFrame, aliases: DataFrame, ident: str, tokens: str) -> DataFrame:
    """(ident, target, n_targets): the target of the first token that is an alias, and how many targets any token has.

    `aliases` has columns alias and target.
    """
    tried = wanted.select(ident, F.posexplode(tokens).alias("at", "alias"))
    met = tried.join(aliases, "alias")
    return met.groupBy(ident).agg(F.min_by("target", F.struct("at", "target")).alias("target"), F.count_distinct("target").alias("n_targets"))


def interval_overlaps(left: DataFrame, right: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Pairs (left_id, right_id) of closed intervals of the same key that overlap.

    Both have columns on + (id, start, end). Each interval is cut into bins of `width`,
    so the join has an equality on key and bin whatever the key's size; a pair counts in
    the bin where its overlap begins.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        cols = [F.col(c).alias(f"{side}_{c}") for c in ("id", "start", "end")]
        return df.select(*on, *cols, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin"))

    met = binned(left, "left").join(binned(right, "right"), [*on, "_bin"])
    begins = F.greatest("left_start", "right_start")
    return met.where((begins <= F.least("left_end", "right_end")) & (F.floor(begins / width) == F.col("_bin"))).select(*on, "left_id", "right_id")


def near_values(left: DataFrame, right: DataFrame, block: Sequence[str], x: str, y: str, limit: float) -> DataFrame:
    """Pairs of the same block with |x - y| <= limit. Values are cut into bins of that width and a left row looks into its own and both next to it, so rows meet by an equality however large the block is."""
    a = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(x) / limit) + k for k in (-1, 0, 1)])))
    b = right.withColumn("_bin", F.floor(F.col(y) / limit))
    return a.join(b, [*block, "_bin"]).withColumn("_d", F.abs(F.col(x) - F.col(y))).where(F.col("_d") <= limit).drop("_bin")


def _nearest_within(targets: DataFrame, pool: DataFrame, block: list[str], x: str, y: str, limit: float, most: int) -> DataFrame:
    """Of the pairs of near_values but for a target with itself, the nearest `most` of each target in each part of the pool, with all that are as far as the last of these.

    `_d` is the distance; the sum of `_n` over a target's rows is the number of its pairs,
    those that are not returned included. Bins are cut into parts of about SIDE rows a
    side. Sorted values are searched, so time and what is written go by rows and not by
    pairs.
    """
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    a = targets.where(finite(x)).withColumn("_bin", F.explode(F.array(*[F.floor(F.col(x) / limit) + k for k in (-1, 0, 1)])))
    b = pool.where(finite(y)).withColumn("_bin", F.floor(F.col(y) / limit))
    at = [*block, "_bin"]

    def parts(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        met = df.join(other.select(*at).distinct(), at, "left_semi")
        cut = met.join(met.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("_parts")), at)
        of = F.pmod(F.xxhash64(*df.columns), F.col("_parts"))
        return cut.groupBy(*at, of.alias("_part")).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in at])).alias(name)).drop("_part")

    tasks = parts(a, b, "_targets").join(parts(b, a, "_pool"), at).select(*block, "_targets", "_pool")
    own, others = ([f for f in df.schema if f.name not in at] for df in (a, b))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t, p = (batch.column(c).slice(k, 1).flatten() for c in ("_targets", "_pool"))
                at_x, at_y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (t.field(x), p.field(y)))
                order = np.argsort(at_y, kind="stable")
                value, first, count = np.unique(at_y[order], return_index=True, return_counts=True)
                place = np.searchsorted(value, at_x)
                low, high = np.searchsorted(value, at_x - limit), np.searchsorted(value, at_x + limit, "right")
                names = t.field("target_id").to_pylist()
                wanted, selves = set(names), {}
                for j, c in enumerate(p.field("control_id").to_pylist()):
                    if c in wanted:
                        selves.setdefault(c, []).append(j)
                before = np.concatenate([[0], np.cumsum(count)])
                sent: list[tuple] = []
                held = 0

                def pairs() -> pa.RecordBatch:
                    i, j, n = np.repeat([s[0] for s in sent], [len(s[1]) for s in sent]), np.concatenate([s[1] for s in sent]), np.concatenate([s[2] for s in sent])
                    of_t, of_p = t.take(pa.array(i)), p.take(pa.array(j))
                    blocks = [pa.repeat(batch.column(c)[k], len(i)) for c in block]
                    return pa.RecordBatch.from_arrays([*blocks, *[of_t.field(f.name) for f in own], *[of_p.field(f.name) for f in others], pa.array(np.abs(at_x[i] - at_y[j])), pa.array(n)], names=[*block, *[f.name for f in own], *[f.name for f in others], "_d", "_n"])

                for i, v in enumerate(at_x):
                    lo, hi = int(low[i]), int(high[i])
                    # the ends go by the difference as it is rounded
                    while lo > 0 and v - value[lo - 1] <= limit:
                        lo -= 1
                    while lo < hi and v - value[lo] > limit:
                        lo += 1
                    while hi < len(value) and value[hi] - v <= limit:
                        hi += 1
                    while hi > lo and value[hi - 1] - v > limit:
                        hi -= 1
                    own_rows = [j for j in selves.get(names[i], ()) if abs(v - at_y[j]) <= limit]
                    n = int(before[hi] - before[lo]) - len(own_rows)
                    if n <= 0:
                        continue
                    reach = most + len(own_rows)
                    left, right = max(lo, int(place[i]) - reach), min(hi, int(place[i]) + reach + 1)
                    far, rows = np.abs(v - value[left:right]), count[left:right].copy()
                    for j in own_rows:
                        w = int(np.searchsorted(value, at_y[j]))
                        if left <= w < right:
                            rows[w - left] -= 1
                    near = np.argsort(far, kind="stable")
                    least = int(np.searchsorted(np.cumsum(rows[near]), min(n, most)))
                    bound = far[near[min(least, len(near) - 1)]]
                    while left > lo and v - value[left - 1] <= bound:
                        left -= 1
                    while right < hi and value[right] - v <= bound:
                        right += 1
                    kept = left + np.flatnonzero(np.abs(v - value[left:right]) <= bound)
                    j = np.concatenate([order[first[w] : first[w] + count[w]] for w in kept])
                    if own_rows:
                        j = j[~np.isin(j, own_rows)]
                    counted = np.zeros(len(j), np.int64)
                    counted[0] = n
                    sent.append((i, j, counted))
                    held += len(j)
                    if held >= PAIRS:
                        yield pairs()
                        sent, held = [], 0
                if sent:
                    yield pairs()

    kinds = {f.name: f.dataType.simpleString() for f in [*a.schema, *b.schema]}
    dealt = tasks.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # small rows that stand for much work
    return dealt.mapInArrow(each, ", ".join([*[f"`{c}` {kinds[c]}" for c in (*block, *(f.name for f in own), *(f.name for f in others))], "_d double, _n long"]))


def staged_match(targets: DataFrame, pool: DataFrame, block: Sequence[str], x: str, y: str, stages: Sequence[float], least: int, most: int, tie: Column) -> DataFrame:
    """Controls for each target within the first caliper |x - y| that has `least` of them, the nearest `most` kept.

    `targets` has target_id and x, `pool` control_id and y, both the columns `block`; `tie`
    may read all. A target that one caliper serves does not enter the next, so wide calipers
    are looked into for the others only. Returns target_id, control_id, stage (1 the
    tightest), pool_size, place. The pairs within a caliper, which grow with the product
    of both sides, are counted and not made: a task hands on a target's nearest `most`,
    and what ties with them.
    """
    found = []
    for k, limit in enumerate(stages, 1):
        met = checkpoint(_nearest_within(targets, pool, list(block), x, y, limit, most))
        served = checkpoint(met.groupBy("target_id").agg(F.sum("_n").alias("pool_size")).where(F.col("pool_size") >= least))
        near = met.join(served, "target_id").select("target_id", "control_id", F.lit(k).alias("stage"), "pool_size", "_d", tie.alias("_tie"))
        found.append(top_per_group(near, ["target_id"], ["_d", "_tie", "control_id"], most, "place"))
        targets = targets.join(served, "target_id", "left_anti")
    return functools.reduce(DataFrame.unionByName, found).drop("_d", "_tie")


def nearest(rows: DataFrame, others: DataFrame, block: Sequence[str], ident: str, x: str, other: str, y: str, stages: Sequence[float], allowed: Column) -> DataFrame:
    """(ident, other, distance): the other row of the block with the least |x - y|, ties by `other`, of those that `allowed` admits; rows without one in the last stage are left out."""
    found = []
    for limit in stages:
        met = near_values(rows, others, block, x, y, limit).where(allowed)
        best = checkpoint(met.groupBy(ident).agg(F.min(F.struct("_d", other)).alias("_m")).select(ident, f"_m.{other}", F.col("_m._d").alias("distance")))
        found.append(best)
        rows = rows.join(best.select(ident), ident, "left_anti")
    return functools.reduce(DataFrame.unionByName, found)
