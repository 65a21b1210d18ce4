"""Allocation, windows and splits, all fixed by hashes rather than by a generator's state."""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weft.checkpoints import checkpoint
from weft.operators.ordered import met_on, row_numbers


def allocate(df: DataFrame, order: Sequence[str], total: int, name: str = "quota") -> DataFrame:
    """`total` spread evenly over the rows, the first ones taking the remainder."""
    numbered = row_numbers(df, [], list(order), "_k").join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    return numbered.select(*df.columns, (F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_k") <= F.lit(total) % F.col("_n"), 1).otherwise(0)).cast("long").alias(name))


def sample_windows(sequences: DataFrame, ident: str, sequence: str, window: int, most_ambiguous: float, target: int, seed: str, group: Sequence[str] = (), complete: bool = False) -> DataFrame:
    """(group, id, start0, place, eligible) of up to `target` windows a group: all eligible starts in the order of a hash.

    Every start is a candidate, those with more than `most_ambiguous` of N are rejected,
    and a start is as likely as any other, so long sequences get their share. A task sends
    only its `target` smallest hashes of each group, and how many starts it saw: `eligible`
    tells a group that falls short, and with `complete` such a group fails the job.
    """
    kinds = dict(sequences.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = defaultdict(list)
        seen: Counter = Counter()
        for b in batches:
            keys = list(zip(*(b.column(g).to_pylist() for g in group), strict=True)) if group else [()] * b.num_rows
            for key, name, text in zip(keys, b.column(ident).to_pylist(), b.column(sequence).to_pylist(), strict=True):
                x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
                if name is None or len(x) < window:
                    continue
                ambiguous = np.concatenate(([0], np.cumsum(x == ord("N"))))
                starts = np.flatnonzero(ambiguous[window:] - ambiguous[:-window] <= most_ambiguous * window).tolist()
                seen[key] += len(starts)
                own = held[key]
                own += [(hashlib.sha256(f"{seed}|{name}|{i}".encode()).hexdigest(), name, i) for i in starts]
                if len(own) > 8 * target + 10_000:
                    held[key] = heapq.nsmallest(target, own)
        rows = [(*key, name, i, h, n) for key, own in held.items() for h, name, i, n in [*((*x, 0) for x in heapq.nsmallest(target, own)), (None, None, None, seen[key])]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    chosen = sequences.select(*group, ident, sequence)
    schema = pa.schema([*(f for f in to_arrow_schema(chosen.schema) if f.name != sequence), ("start0", pa.int64()), ("_h", pa.string()), ("_n", pa.int64())])
    sent = checkpoint(chosen.mapInArrow(each, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"`{ident}` {kinds[ident]}", "start0 long, _h string, _n long"])))
    eligible = sent.groupBy(*group).agg(F.sum("_n").alias("eligible"))
    short = eligible.where(F.col("eligible") < target).limit(1).collect() if complete else []
    if short:
        raise ValueError(f"fewer than {target} windows: {tuple(short[0])}")
    placed = row_numbers(sent.where("_h IS NOT NULL").drop("_n"), list(group), ["_h", ident, "start0"], "place").where(F.col("place") <= target).drop("_h")
    return met_on(placed, eligible, list(group))


def equal_budget_cohorts(df: DataFrame, arm: str, ident: str, arms: Sequence[str], total: int, seed: str, union: str = "union") -> DataFrame:
    """(cohort, arm, id): the same number of rows for every arm, by hash, and a union cohort that shares `total` out evenly over the arms (the first ones take the remainder)."""
    keyed = df.where(F.col(arm).isin(*arms)).select(arm, ident, F.sha2(F.concat_ws("|", F.lit(seed), F.col(arm), F.col(ident).cast("string")), 256).alias("_h"))
    placed = checkpoint(row_numbers(keyed, [arm], ["_h", ident], "_k").where(F.col("_k") <= total))
    share = F.element_at(F.create_map(*[F.lit(x) for i, a in enumerate(arms) for x in (a, total // len(arms) + (i < total % len(arms)))]), F.col(arm))
    each = placed.select(F.col(arm).alias("cohort"), arm, ident)
    return each.union(placed.where(F.col("_k") <= share).select(F.lit(union).alias("cohort"), arm, ident))


def split_by(df: DataFrame, development: Column, test: Column, name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(test, "test").when(development, "development").otherwise("train"))
