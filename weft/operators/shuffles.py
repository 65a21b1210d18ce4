"""Score tests of many features against shuffled labels, the null model fitted anew for each shuffle.

A row carries its label in every shuffle as one vector of bits. All null models are fitted
together: a step is one pass in which each task adds up the weighted Gram matrices of its
rows for all shuffles, and the coefficients (shuffles times predictors) are all that is
gathered. Features then meet their rows once, and every feature is scored against all
shuffles as sums of products; a feature in very many rows is split over `SALTS` tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.ordered import row_numbers
from weft.operators.replicates import BUCKET, HASHES, PACKED, _spread
from weft.operators.resampling import permuted_labels

#: RANGES: ranges of shuffles that the rows are at most sent to.
SALTS, AT_ONCE, MANY_STEPS, RANGES = 8, 1024, 100, 24


def shuffled_labels(df: DataFrame, ident: str, label: str, replicates: int, seed: str) -> DataFrame:
    """(ident, labels): the labels 0 or 1 of every row after each shuffle, a bit each, first the highest.

    The label of the row whose place by id is this row's place by hash, as in
    `permuted_labels`. Shuffles are tasks up to PACKED rows; beyond, they are sorted as rows.
    """
    rows = df.select(F.col(ident).alias("_id"), F.col(label).cast("int").alias("_y"))
    if rows.limit(PACKED + 1).count() > PACKED:
        each = permuted_labels(rows, [], "_id", "_y", replicates, seed)
        packed = each.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "permuted"))), lambda x: x.permuted).alias("l"))
        full = F.concat("l", F.array_repeat(F.lit(0), -replicates % 4))
        digit = lambda k: F.hex(F.aggregate(F.slice(full, k, 4), F.lit(0), lambda bits, y: bits * 2 + y))
        digits = F.transform(F.sequence(F.lit(1), F.lit(replicates), F.lit(4)), digit)
        return packed.select(F.col("_id").alias(ident), F.unhex(F.concat(F.array_join(digits, ""), F.lit("0" * (-(-replicates // 4) % 2)))).alias("labels"))
    numbered = checkpoint(row_numbers(rows, [], ["_id"], "_i").withColumn("_i", F.col("_i") - 1))
    whole = numbered.agg(F.sort_array(F.collect_list(F.struct("_i", F.col("_id").cast("string").alias("name"), F.col("_y").alias("y")))).alias("rows"), F.count(F.lit(1)).alias("n")).where("n > 0")
    step = F.greatest(F.lit(-(-replicates // RANGES)).cast("long"), F.floor(F.lit(HASHES) / F.col("n")))
    tasks = whole.select("rows", step.alias("step"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"), step)).alias("first"))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            for k in range(b.num_rows):
                held = b.column("rows").slice(k, 1).flatten()
                names, y = [x.encode() for x in held.field("name").to_pylist()], held.field("y").to_numpy().astype(np.uint8)
                first, last = b.column("first")[k].as_py(), min(replicates + 1, b.column("first")[k].as_py() + b.column("step")[k].as_py())
                got = np.empty((len(y), last - first), np.uint8)
                for r in range(first, last):
                    head = f"{seed}|{r}|".encode()
                    digests = [sha(head + x).digest() for x in names]
                    got[sorted(range(len(y)), key=digests.__getitem__), r - first] = y
                cuts = range(0, len(y), BUCKET)
                yield pa.RecordBatch.from_arrays([pa.array([c // BUCKET for c in cuts], pa.int64()), pa.array([first] * len(cuts), pa.int64()), pa.array([got[c : c + BUCKET].tobytes() for c in cuts], pa.binary())], names=["bucket", "first", "part"])

    def joined(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("first")
        first = [*t.column("first").to_pylist(), replicates + 1]
        parts = [np.frombuffer(p, np.uint8).reshape(-1, b - a) for p, a, b in zip(t.column("part").to_pylist(), first, first[1:])]
        whole = np.hstack(parts)
        return pa.table([pa.array(np.arange(len(whole)) + key[0].as_py() * BUCKET, pa.int64()), pa.array([r.tobytes() for r in np.packbits(whole, axis=1)], pa.binary())], names=["_i", "labels"])

    vectors = _spread(tasks).mapInArrow(shuffle, "bucket long, first long, part binary").groupBy("bucket").applyInArrow(joined, "_i long, labels binary")
    return vectors.join(numbered, "_i").select(F.col("_id").alias(ident), "labels")


def _labels(b, replicates: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(b.column("labels").to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return np.unpackbits(packed, axis=1, count=replicates).astype(np.float64)


def _predictors(b, k: int) -> np.ndarray:
    return np.column_stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(k)])


def _model(x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """eta, mu and weight of rows by models."""
    eta = np.clip(x @ beta.T, -30, 30)
    mu = 1 / (1 + np.exp(-eta))
    return eta, mu, mu * (1 - mu)


def shuffled_nulls(rows: DataFrame, predictors: int, replicates: int, ridge: float = 1e-8, steps: int = MANY_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (replicates x predictors) of all null models, and the inverse information of each.

    `rows` has _x0.. and labels. A step sums replicates x predictors^2 numbers over tasks;
    those sums are what reaches the driver.
    """
    k, beta = predictors, np.zeros((replicates, predictors))
    names = [f"g{i}" for i in range(k * (k + 1))]

    def grams(current: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((replicates, k, k + 1))
            for b in batches:
                for a in range(0, b.num_rows, AT_ONCE):
                    part = b.slice(a, AT_ONCE)
                    x, y = _predictors(part, k), _labels(part, replicates)
                    eta, mu, w = _model(x, current)
                    z = w * eta + y - mu
                    for i in range(k):
                        total[:, i, :k] += (w * x[:, i : i + 1]).T @ x
                        total[:, i, k] += z.T @ x[:, i]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *[pa.array(c) for c in total.reshape(replicates, -1).T.copy()]], names=["r", *names])

        sums = rows.mapInArrow(add, ", ".join(["r long", *[f"{n} double" for n in names]])).groupBy("r").agg(*[F.sum(n).alias(n) for n in names])
        out = np.zeros((replicates, k * (k + 1)))
        for row in sums.collect():
            out[row["r"]] = [row[n] for n in names]
        return out.reshape(replicates, k, k + 1)

    for _ in range(steps):
        g = grams(beta)
        new = np.linalg.solve(g[:, :, :k] + ridge * np.eye(k), g[:, :, k:])[:, :, 0]
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            return beta, np.linalg.inv(g[:, :, :k] + ridge * np.eye(k))
    raise ArithmeticError(f"a null model did not settle in {steps} steps")


def shuffled_scores(rows: DataFrame, features: DataFrame, ident: str, label: str, predictors: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(feature, z binary): the score statistic of every feature in every shuffle as little-endian doubles, NaN where a feature has no variance.

    `features` is long: (ident, feature, value), zeros left out. `rows` has one row for each
    ident; rows with a null label or predictor are left out.
    """
    k = 1 + len(predictors)
    whole = rows.select(ident, label, *predictors).dropna()
    labels = shuffled_labels(whole, ident, label, replicates, seed)
    x = [F.lit(1.0).alias("_x0"), *[F.col(p).cast("double").alias(f"_x{i + 1}") for i, p in enumerate(predictors)]]
    base = checkpoint(whole.join(labels, ident).select(F.col(ident).alias("_id"), *x, "labels"))
    beta, inverse = shuffled_nulls(base.drop("_id"), k, replicates)
    met = features.select(F.col(ident).alias("_id"), "feature", F.col("value").cast("double").alias("value")).join(base, "_id")
    salted = met.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).repartition("feature", "_salt").sortWithinPartitions("feature")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([total.tobytes()], pa.binary())], names=["feature", "sums"])

        for b in batches:
            f = np.array(b.column("feature").to_pylist(), object)
            cuts = [*np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))).tolist(), len(f)] if len(f) else [0]
            for first, last in zip(cuts, cuts[1:]):
                if f[first] != name:
                    if name is not None:
                        yield out()
                    name, total = f[first], np.zeros((2 + k, replicates))
                for a in range(first, last, AT_ONCE):
                    part = b.slice(a, min(AT_ONCE, last - a))
                    xs, v = _predictors(part, k), part.column("value").to_numpy(zero_copy_only=False)
                    _, mu, w = _model(xs, beta)
                    total[0] += v @ (_labels(part, replicates) - mu)
                    total[1] += (v * v) @ w
                    total[2:] += (xs * v[:, None]).T @ w
        if name is not None:
            yield out()

    def score(key: tuple, t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(p).reshape(2 + k, replicates) for p in t.column("sums").to_pylist())
        cross = s[2:].T
        variance = s[1] - np.einsum("ri,rij,rj->r", cross, inverse, cross)
        with np.errstate(invalid="ignore"):
            z = np.where(variance > 1e-10, s[0] / np.sqrt(np.maximum(variance, 1e-300)), np.nan)
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([z.astype("<f8").tobytes()], pa.binary())], names=["feature", "z"])

    columns = ["feature", "value", *[f"_x{i}" for i in range(k)], "labels"]
    # a feature's sums are at most one row for each salt and task
    return salted.select(*columns).mapInArrow(add, "feature string, sums binary").groupBy("feature").applyInArrow(score, "feature string, z binary")


def null_extremes(scores: DataFrame, replicates: int, beyond: float) -> DataFrame:
    """(replicate, max_abs_z, n_beyond) over all features; max is null where no feature has a score."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, n = np.full(replicates, -np.inf), np.zeros(replicates, np.int64)
        for b in batches:
            for raw in b.column("z").to_pylist():
                z = np.abs(np.frombuffer(raw, "<f8"))
                most, n = np.fmax(most, z), n + (z >= beyond)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates) + 1), pa.array(most), pa.array(n)], names=["replicate", "m", "n"])

    g = scores.select("z").mapInArrow(add, "replicate long, m double, n long").groupBy("replicate").agg(F.max("m").alias("m"), F.sum("n").alias("n_beyond"))
    return g.select("replicate", F.when(F.col("m") >= 0, F.col("m")).alias("max_abs_z"), "n_beyond")
