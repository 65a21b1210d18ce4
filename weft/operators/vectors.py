"""Embedding columns: array<float> beside a key, never aligned by position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weft.checkpoints import checkpoint
from weft.operators.ordered import met_on


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def relative_displacement(a: Column, b: Column) -> Column:
    """|b - a| / |a|"""
    d = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    return F.try_divide(norm(d), norm(a))


def both_strands(e: Column, size: int) -> Column:
    """Mean of the first half and the reversed second half."""
    h = size // 2
    return F.zip_with(F.slice(e, 1, h), F.reverse(F.slice(e, h + 1, h)), lambda x, y: (x + y) / 2)


#: Rows of a matrix of moments that travel together.
_ROWS = 64


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _moments(pairs: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """(group, what, i, x binary): sums (n and both columns', what = 'sums') and rows of the products aa, bb, ab, `_ROWS` at a time from row i, as packed doubles.

    A task sums its own rows, and the tasks' sums are added by group and block of rows, so
    no place holds more than one block for each task. All vectors of a column have one length.
    """
    kinds = {g: dict(pairs.dtypes)[g] for g in group}
    schema = pa.schema([*(f for f in to_arrow_schema(pairs.select(*group).schema)), ("what", pa.string()), ("i", pa.int32()), ("x", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[str, np.ndarray]] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            code = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
            order = np.argsort(code, kind="stable")
            x, y = _matrix(batch.column(a))[order], _matrix(batch.column(b))[order]
            cuts = np.searchsorted(code[order], np.arange(len(number) + 1))
            for key, k in number.items():
                u, v = x[cuts[k] : cuts[k + 1]], y[cuts[k] : cuts[k + 1]]
                new = {"sums": np.concatenate(([len(u)], u.sum(0), v.sum(0))), "aa": u.T @ u, "bb": v.T @ v, "ab": u.T @ v}
                old = held.get(key)
                held[key] = new if old is None else {w: old[w] + m for w, m in new.items()}
        for key, sums in held.items():
            rows = [(*key, w, i, part.tobytes()) for w, m in sums.items() for i, part in ([(0, m)] if w == "sums" else [(i, m[i : i + _ROWS]) for i in range(0, len(m), _ROWS)])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def added(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for p in parts:
            for x in p.column("x").to_pylist():
                total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], f.type) for k, f in zip(key, schema, strict=False)), pa.array([total.tobytes()])], schema=schema)

    declared = "".join(f"`{g}` {k}, " for g, k in kinds.items()) + "what string, i int, x binary"
    return pairs.select(*group, a, b).mapInArrow(each, declared).groupBy(*group, "what", "i").applyInArrow(added, declared)


def _centred(what: str, i: int, rows: bytes, sums: np.ndarray, d: int) -> np.ndarray:
    """Rows of a matrix of products less n times the products of means; d is the first column's length."""
    n, a, b = sums[0], sums[1 : d + 1], sums[d + 1 :]
    left, right = (b, b) if what == "bb" else (a, a if what == "aa" else b)
    m = np.frombuffer(rows).reshape(-1, len(right))
    return m - np.outer(left[i : i + len(m)], right) / n


def linear_cka(pairs: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, cka) of the centred matrices whose rows are the two columns; null where one is constant. Only squares of norms are gathered, and only in the grouped sum."""
    found = checkpoint(_moments(pairs, group, a, b))
    sums = found.where("what = 'sums'").select(*group, F.col("x").alias("sums"))
    size = pairs.select(F.size(a).alias("d")).limit(1)
    met = met_on(found.where("what <> 'sums'"), sums, list(group)).crossJoin(F.broadcast(size))

    @F.pandas_udf("double")
    def square(what: pd.Series, i: pd.Series, x: pd.Series, sums: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([float((_centred(w, k, m, np.frombuffer(s), n) ** 2).sum()) for w, k, m, s, n in zip(what, i, x, sums, d, strict=True)], dtype="float64")

    g = met.select(*group, "what", square("what", "i", "x", "sums", "d").alias("q")).groupBy(*group)
    of = lambda w: F.sum(F.when(F.col("what") == w, F.col("q")))
    return g.agg(F.try_divide(of("ab"), F.sqrt(of("aa") * of("bb"))).alias("cka"))


def procrustes_residual(pairs: DataFrame, a: str, b: str) -> float:
    """What is left between the centred, unit-norm matrices after the best rotation. The products of the two columns' d numbers reach the driver: 8 d^2 bytes, three times."""
    found = {(r.what, r.i): r.x for r in _moments(pairs, [], a, b).collect()}
    sums, d = np.frombuffer(found["sums", 0]), pairs.select(F.size(a)).first()[0]
    aa, bb, ab = (np.concatenate([_centred(w, i, x, sums, d) for (k, i), x in sorted(found.items()) if k == w]) for w in ("aa", "bb", "ab"))
    s = np.linalg.svd(ab / np.sqrt(np.trace(aa) * np.trace(bb)), compute_uv=False).sum()
    return float(np.sqrt(max(0.0, 2 - 2 * s)))


def nearest_arm(cka: DataFrame, distances: DataFrame, arm: str) -> DataFrame:
    """(by_cka, by_cosine, concordant): the arm with the largest CKA and the one with the least median distance, ties by name.

    `cka` has (arm, cka), `distances` (arm, distance) with one row for each compared pair of vectors.
    """
    first = cka.agg(F.min_by(arm, F.struct(-F.col("cka"), arm)).alias("by_cka"))
    second = distances.groupBy(arm).agg(F.percentile("distance", 0.5).alias("_m")).agg(F.min_by(arm, F.struct("_m", arm)).alias("by_cosine"))
    return first.crossJoin(second).withColumn("concordant", F.col("by_cka") == F.col("by_cosine"))


def principal_components(df: DataFrame, ident: str, embedding: str, k: int) -> tuple[DataFrame, list[float]]:
    """(ident, components vector), and the share of variance that each explains."""
    v = df.select(ident, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="components").fit(v)
    return model.transform(v).select(ident, "components"), [float(x) for x in model.explainedVariance]


def attribution(df: DataFrame, gene: str, kind: str, value: str, controls: int) -> DataFrame:
    """(gene, disruption, control_median, control_sd, delta) of genes that have one disruption and `controls` controls."""
    hit, control = F.when(F.col(kind) == "disruption", F.col(value)), F.when(F.col(kind) == "control", F.col(value))
    g = df.groupBy(gene).agg(F.count(hit).alias("_h"), F.count(control).alias("_c"), F.max(hit).alias("disruption"), F.percentile(control, 0.5).alias("control_median"), F.stddev_samp(control).alias("control_sd"))
    return g.where((F.col("_h") == 1) & (F.col("_c") == controls)).select(gene, "disruption", "control_median", "control_sd", (F.col("disruption") - F.col("control_median")).alias("delta"))
