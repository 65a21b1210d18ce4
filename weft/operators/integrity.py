"""Named checks, decisions, fingerprints and comparisons of results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, **conditions: Column) -> DataFrame:
    """(name, passed) for named aggregate conditions, in one pass."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()])
    return row.unpivot([], list(conditions), "name", "passed")


def decision(tasks: DataFrame, positive: Column, least_positive: int, reversal: Column, *more: Column) -> DataFrame:
    """One row: how many tasks are positive or reversed, and whether to continue."""
    p, r = F.count_if(positive), F.count_if(reversal)
    verdict = F.when((p >= least_positive) & (r == 0), "continue_full_multiseed").otherwise("stop")
    return tasks.agg(p.alias("positive_tasks"), r.alias("reversals"), *more, verdict.alias("decision"))


def row_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: n and an order-free fingerprint of the rows (xor of their hashes, with their number)."""
    each = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(each).alias("fingerprint"))


def settings_fingerprint(settings: dict) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def frame_mismatches(observed: DataFrame, expected: DataFrame, key: Sequence[str], numeric: Sequence[str] = (), exact: Sequence[str] = (), atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """(key..., column) of every cell that differs, or '<row>' where a row is on one side only."""
    a = observed.select(*key, *[F.col(c).alias(f"a_{c}") for c in (*numeric, *exact)], F.lit(True).alias("_a"))
    b = expected.select(*key, *[F.col(c).alias(f"b_{c}") for c in (*numeric, *exact)], F.lit(True).alias("_b"))
    both = a.join(b, list(key), "full")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    far = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) & ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= atol + rtol * F.abs(F.col(f"b_{c}")), F.lit(False))
    found = F.when(lone, F.array(F.lit("<row>"))).otherwise(F.array_compact(F.array(*[F.when(far(c), c) for c in numeric], *[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in exact])))
    return both.select(*key, F.explode(found).alias("column"))


def pair_integrity(df: DataFrame, pair: str, label: str) -> DataFrame:
    """(pair, n, labels) of pairs that are not two rows with two labels."""
    return df.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels")).where("n <> 2 OR labels <> 2")


def file_hashes(df: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of rows read with the binaryFile source."""
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def freeze_mismatches(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of manifest (path, sha256) whose file is missing or differs."""
    o = observed.select("path", F.col("sha256").alias("found"))
    return manifest.join(o, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))
