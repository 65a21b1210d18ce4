"""Negative-binomial differential expression of two conditions, gene by gene.

Counts are gathered by gene (a gene has at most one count for each sample) and genes are
fitted in batches of arrays. What genes share is fitted over all of them by grouped sums:
size factors, the trend of dispersion over the mean, the spread around that trend. Only
those few numbers and the list of samples (at most `MANY_SAMPLES`) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.statistics import size_factors

MANY_SAMPLES, GENES = 20_000, 500
LEAST, LEAST_MEAN, LEAST_PRIOR = 1e-8, 0.5, 0.25


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers: Stirling's series after eight steps up."""
    x = np.asarray(x, float)
    z, down = x + 8, np.zeros_like(x)
    for k in range(8):
        down += np.log(x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - down


def trigamma(x: float) -> float:
    """Second derivative of ln gamma, by steps up and its series."""
    out = 0.0
    while x < 12:
        out, x = out + 1 / x**2, x + 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def profile(y: np.ndarray, mu: np.ndarray, one: np.ndarray, log_alpha: np.ndarray) -> np.ndarray:
    """Log likelihood of dispersions given means, less half the log determinant of the information about the two coefficients. Genes by samples."""
    alpha = np.exp(log_alpha)[:, None]
    r = 1 / alpha
    ll = (log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1.0) - r * np.log1p(alpha * mu) + y * (np.log(mu) - np.log(r + mu))).sum(1)
    w = mu / (1 + alpha * mu)
    return ll - 0.5 * (np.log(w[:, one].sum(1)) + np.log(w[:, ~one].sum(1)))


def _best_dispersion(y, mu, one, middle=None, spread=None) -> np.ndarray:
    """ln of the dispersion that maximises the profile, and the prior around `middle` if there is one: a grid, refined three times."""
    low, high = np.full(len(y), math.log(LEAST)), np.full(len(y), math.log(max(10.0, y.shape[1])))
    for _ in range(4):
        points = np.linspace(0, 1, 25)
        values = []
        for t in points:
            at = low + t * (high - low)
            v = profile(y, mu, one, at)
            values.append(v if middle is None else v - (at - middle) ** 2 / (2 * spread))
        k = np.argmax(np.stack(values), 0)
        step = (high - low) / (len(points) - 1)
        best = low + k * step
        low, high = np.maximum(best - step, low), np.minimum(best + step, high)
    return (low + high) / 2


def _means(y: np.ndarray, size: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Mean per unit of size of one condition, by scoring steps on its logarithm; no less than what gives a mean count of LEAST_MEAN."""
    least = LEAST_MEAN / size.mean()
    q = np.maximum((y / size).mean(1), least)
    for _ in range(50):
        mu = q[:, None] * size
        over = 1 + alpha[:, None] * mu
        move = ((y - mu) / over).sum(1) / (mu / over).sum(1)
        q = np.maximum(q * np.exp(np.clip(move, -3, 3)), least)
        if np.abs(move[q > least]).max(initial=0) < 1e-10:
            break
    return q


def wald_tests(counts: DataFrame, samples: DataFrame, sample: str, gene: str, count: str, condition: str) -> DataFrame:
    """(gene, base_mean, dispersion, log2_fold, se, z, p) of condition 1 against 0, for genes with a count.

    `counts` is long, absent counts are zero; `samples` names the condition (0 or 1) of each
    sample, at least two of either. Gene-wise dispersions maximise the adjusted profile
    likelihood with means by condition; their trend over the mean is a + b / mean (or their
    mean, where that fit fails); the final one is shrunk to the trend, except where it lies
    over two standard deviations above it. Standard errors are Wald's.
    """
    design = samples.select(F.col(sample).alias("s"), F.col(condition).cast("int").alias("c"))
    long = counts.join(F.broadcast(design.select(F.col("s").alias(sample))), sample).select(sample, F.col(gene).alias("g"), F.col(count).cast("double").alias("y"))
    factors = size_factors(long, sample, "g", "y")
    held = design.join(factors.select(F.col(sample).alias("s"), "factor"), "s", "left").orderBy("s").limit(MANY_SAMPLES + 1).collect()
    if len(held) > MANY_SAMPLES:
        raise ValueError(f"over {MANY_SAMPLES} samples")
    if any(r.factor is None for r in held):
        raise ValueError("a sample shares no gene with all others")
    place, size, one = {r.s: k for k, r in enumerate(held)}, np.array([r.factor for r in held]), np.array([r.c == 1 for r in held])
    if min(one.sum(), (~one).sum()) < 2:
        raise ValueError("fewer than two samples of a condition")
    kind = counts.schema[gene].dataType.simpleString()
    rows = checkpoint(long.where("y > 0").groupBy("g").agg(F.collect_list(F.struct(F.col(sample).alias("s"), "y")).alias("held")))

    def fitted(schema: str, fit):
        """Run `fit` on dense batches of genes."""
        names = [c.split()[0] for c in schema.split(", ")]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, GENES):
                    part = b.slice(a, GENES)
                    held = part.column("held")
                    y = np.zeros((part.num_rows, len(size)))
                    flat = held.flatten()
                    y[np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy())), [place[s] for s in flat.field("s").to_pylist()]] = flat.field("y").to_numpy(zero_copy_only=False)
                    out = fit(y, part)
                    yield pa.RecordBatch.from_arrays([part.column("g"), *[pa.array(o, pa.float64(), from_pandas=True) for o in out]], names=["g", *names])

        return lambda df: df.mapInArrow(each, f"g {kind}, {schema}")

    def by_condition(y: np.ndarray) -> np.ndarray:
        q = np.where(one, (y / size)[:, one].mean(1)[:, None], (y / size)[:, ~one].mean(1)[:, None])
        return np.maximum(q * size, LEAST_MEAN)

    def genewise(y, part):
        return (y / size).mean(1), np.exp(_best_dispersion(y, by_condition(y), one))

    first = checkpoint(fitted("mean double, alpha double", genewise)(rows))
    a0, a1 = _trend(first)
    trend = F.lit(a0) + F.lit(a1) / F.col("mean")
    off = F.ln("alpha") - F.ln(trend)
    spread = first.where(F.col("alpha") > 100 * LEAST).agg(F.var_samp(off)).first()[0] or 0.0
    prior = max(spread - trigamma((len(size) - 2) / 2), LEAST_PRIOR)

    def tested(y, part):
        mean, alone = (part.column(c).to_numpy(zero_copy_only=False) for c in ("mean", "alpha"))
        middle = np.log(a0 + a1 / mean)
        alpha = np.exp(_best_dispersion(y, by_condition(y), one, middle, prior))
        alpha = np.where(np.log(alone) > middle + 2 * math.sqrt(spread), alone, alpha)
        q1, q0 = _means(y[:, one], size[one], alpha), _means(y[:, ~one], size[~one], alpha)
        information = [(np.maximum(q[:, None] * size[own], LEAST_MEAN) / (1 + alpha[:, None] * np.maximum(q[:, None] * size[own], LEAST_MEAN))).sum(1) for q, own in ((q1, one), (q0, ~one))]
        fold, se = np.log2(q1 / q0), np.sqrt(1 / information[0] + 1 / information[1]) / math.log(2)
        z = fold / se
        return mean, alpha, fold, se, z, [math.erfc(abs(v) / math.sqrt(2)) for v in z]

    done = fitted("base_mean double, dispersion double, log2_fold double, se double, z double, p double", tested)(rows.join(first, "g").select("g", "held", "mean", "alpha"))
    return done.withColumnRenamed("g", gene)


def _trend(first: DataFrame) -> tuple[float, float]:
    """a and b of dispersion = a + b / mean: least squares weighted by the squared fit, genes far off the fit left out, to convergence; their mean and 0 where that gives no positive curve."""
    x, y = 1 / F.col("mean"), F.col("alpha")
    usable = first.where((F.col("alpha") > 100 * LEAST) & (F.col("mean") > 0))
    a0, a1 = 0.1, 1.0
    for _ in range(50):
        fit = F.lit(a0) + F.lit(a1) * x
        w = 1 / (fit * fit)
        s = usable.where((y / fit > 1e-4) & (y / fit < 15)).agg(*[F.sum(w * v) for v in (F.lit(1.0), x, x * x, y, x * y)]).first()
        if s[0] is None:
            break
        det = s[0] * s[2] - s[1] * s[1]
        if det <= 1e-12 * s[0] * s[2]:
            break
        b0, b1 = (s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det
        if b0 <= 0 or b1 <= 0:
            break
        moved = math.log(b0 / a0) ** 2 + math.log(b1 / a1) ** 2
        a0, a1 = b0, b1
        if moved < 1e-12:
            return a0, a1
    return usable.agg(F.avg("alpha")).first()[0] or LEAST, 0.0
