"""Tests, models and meta-analysis. Sums come from Spark; only matrices of a few columns are solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.ordered import average_ranks, met_on, running_sums


def _log_choose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _hypergeometric(lo: int, hi: int, total: int, marked: int, drawn: int):
    """Probabilities of lo..hi marked among `drawn` of `total`."""
    base = _log_choose(total, drawn)
    return [math.exp(_log_choose(marked, x) + _log_choose(total - marked, drawn - x) - base) for x in range(lo, hi + 1)]


def hypergeometric_tail():
    """Column function (k, total, marked, drawn): P(X >= k)."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        def one(k, n, m, d):
            lo, hi = max(k, 0, d - (n - m)), min(m, d)
            return 1.0 if k <= max(0, d - (n - m)) else min(1.0, math.fsum(_hypergeometric(lo, hi, n, m, d)))

        return pd.Series([one(*map(int, x)) for x in zip(k, total, marked, drawn)], dtype="float64")

    return tail


def fisher_two_sided():
    """Column function (a, b, c, d): sum of the probabilities of tables no likelier than this one."""
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(a, b, c, d):
            n, m, k = a + b + c + d, a + b, a + c
            lo = max(0, k - (n - m))
            each = _hypergeometric(lo, min(m, k), n, m, k)
            return min(1.0, math.fsum(x for x in each if x <= each[a - lo] * (1 + 1e-7)))

        return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")

    return p


def normal_tail():
    """Column function z: P(Z > z)."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)) if pd.notna(x) else None).astype("float64")

    return tail


def clopper_pearson(level: float = 0.95):
    """Column function (successes, total): exact interval as struct<low, high>, by bisection on binomial tails."""

    @F.pandas_udf("low double, high double")
    def interval(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        def upper_tail(k, n, p):  # P(X >= k)
            if k <= 0:
                return 1.0
            lp, lq = math.log(p), math.log1p(-p)
            return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k, n + 1))

        def solve(f, target):
            lo, hi = 1e-12, 1 - 1e-12
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
            return (lo + hi) / 2

        a, out = (1 - level) / 2, []
        for k, m in zip(x, n):
            k, m = int(k), int(m)
            out.append((0.0 if k == 0 else solve(lambda p: upper_tail(k, m, p), a), 1.0 if k == m else solve(lambda p: upper_tail(k + 1, m, p), 1 - a)))
        return pd.DataFrame(out, columns=["low", "high"])

    return interval


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Haldane-corrected."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def fisher_combined(p: Column, q: Column) -> Column:
    """Combined p of two tests; p below 1e-300 counts as that."""
    half = -(F.ln(F.greatest(p, F.lit(1e-300))) + F.ln(F.greatest(q, F.lit(1e-300))))
    return F.exp(-half) * (1 + half)


def minimum_detectable_effect(sd: float, n: int, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> float:
    return (z_alpha + z_power) * sd / math.sqrt(n)


def fixed_effect(df: DataFrame, group: Sequence[str], beta: str, se: str) -> DataFrame:
    """(group, studies, beta, se, z, q, i2): inverse-variance mean, Cochran's Q and I squared."""
    w = 1 / (F.col(se) * F.col(se))
    s = df.groupBy(*group).agg(F.count(F.lit(1)).alias("studies"), F.sum(w).alias("w"), F.sum(w * F.col(beta)).alias("wb"), F.sum(w * F.col(beta) * F.col(beta)).alias("wbb"))
    q = F.greatest(F.lit(0.0), F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w"))
    return s.select(*group, "studies", (F.col("wb") / F.col("w")).alias("beta"), F.sqrt(1 / F.col("w")).alias("se"), (F.col("wb") / F.sqrt("w")).alias("z"), q.alias("q"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("studies") - 1)) / q)).otherwise(0.0).alias("i2"))


def random_effects(df: DataFrame, group: Sequence[str], beta: str, se: str, z90: float = 1.6448536269514722) -> DataFrame:
    """(group, studies, tau2, beta, se, low90, high90, direction): DerSimonian-Laird, and the share of studies on the mean's side."""
    w = 1 / (F.col(se) * F.col(se))
    s = df.groupBy(*group).agg(F.count(F.lit(1)).alias("studies"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * F.col(beta)).alias("wb"), F.sum(w * F.col(beta) * F.col(beta)).alias("wbb"))
    q = F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w")
    tau = s.select(*group, "studies", F.coalesce(F.greatest(F.lit(0.0), F.try_divide(q - (F.col("studies") - 1), F.col("w") - F.col("ww") / F.col("w"))), F.lit(0.0)).alias("tau2"))
    v = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    m = df.join(tau, list(group)).groupBy(*group, "studies", "tau2").agg(F.sum(v).alias("v"), F.sum(v * F.col(beta)).alias("vb"), F.count_if(F.col(beta) > 0).alias("up"), F.count_if(F.col(beta) < 0).alias("down"))
    mean, err = F.col("vb") / F.col("v"), F.sqrt(1 / F.col("v"))
    return m.select(*group, "studies", "tau2", mean.alias("beta"), err.alias("se"), (mean - z90 * err).alias("low90"), (mean + z90 * err).alias("high90"), (F.when(mean > 0, F.col("up")).otherwise(F.col("down")) / F.col("studies")).alias("direction"))


def robust_labels(df: DataFrame, gene: str, effect: str, q: str, low: str, high: str, bound: float = 0.75, most_q: float = 0.10, share: float = 2 / 3) -> DataFrame:
    """(gene, studies, supporting, equivalent, label): positive if enough studies have q <= most_q and one direction of at least `bound`; negative if enough have an interval within the bounds."""
    up, down = (F.col(q) <= most_q) & (F.col(effect) >= bound), (F.col(q) <= most_q) & (F.col(effect) <= -bound)
    g = df.groupBy(gene).agg(F.count(F.lit(1)).alias("studies"), F.greatest(F.count_if(up), F.count_if(down)).alias("supporting"), F.count_if((F.col(low) > -bound) & (F.col(high) < bound)).alias("equivalent"))
    label = F.when(F.col("supporting") >= share * F.col("studies"), "positive").when((F.col("equivalent") >= share * F.col("studies")) & (F.col("supporting") == 0), "negative").otherwise("ambiguous")
    return g.select(gene, "studies", "supporting", "equivalent", label.alias("label"))


def _moments(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """Matrix of sums of products of the columns."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = df.agg(*[F.sum(w * columns[i] * columns[j]).alias(f"m{k}") for k, (i, j) in enumerate(pairs)]).first()
    m = np.zeros((len(columns), len(columns)))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = m[j, i] = got[k] if got[k] is not None else 0.0
    return m


def _dot(columns: Sequence[Column], values) -> Column:
    return sum((c * float(v) for c, v in zip(columns, values)), F.lit(0.0))


def ols_hc3(df: DataFrame, response: str, predictors: Sequence[str]) -> DataFrame:
    """(term, beta, se): least squares with the HC3 sandwich, in two passes."""
    x = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors]]
    k = len(x)
    m = _moments(df, [*x, F.col(response).cast("double")])
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, k]
    leverage = sum((_dot(x, inverse[i]) * x[i] for i in range(k)), F.lit(0.0))
    e = (F.col(response) - _dot(x, beta)) / (1 - leverage)
    meat = _moments(df, x, e * e)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    return df.sparkSession.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(["intercept", *predictors], beta, se)], "term string, beta double, se double")


def logistic_null(df: DataFrame, label: str, predictors: Sequence[str], ridge: float = 1e-8, steps: int = 100) -> list[float]:
    """Coefficients, constant first, by iteratively reweighted least squares; one aggregate a step."""
    x = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors]]
    beta = np.zeros(len(x))
    for _ in range(steps):
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _dot(x, beta)))
        mu = 1 / (1 + F.exp(-eta))
        w = mu * (1 - mu)
        z = eta + (F.col(label) - mu) / w
        m = _moments(df, [*x, z], w)
        k = len(x)
        new = np.linalg.solve(m[:k, :k] + ridge * np.eye(k), m[:k, k])
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            return beta.tolist()
    raise ArithmeticError(f"the logistic model did not settle in {steps} steps")


def score_tests(rows: DataFrame, features: DataFrame, ident: str, label: str, predictors: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """(feature, score, variance, z): efficient score of each feature given the null model.

    `features` is long: (ident, feature, value), zeros left out. One grouped sum a feature.
    """
    x = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors]]
    mu = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _dot(x, beta)))))
    base = rows.withColumn("_mu", mu).withColumn("_w", F.col("_mu") * (1 - F.col("_mu")))
    inverse = np.linalg.inv(_moments(base, x, F.col("_w")))
    met = features.join(base.select(ident, F.col(label).alias("_y"), "_mu", "_w", *[c.alias(f"_x{i}") for i, c in enumerate(x)]), ident)
    v = F.col("value")
    cross = [F.col(f"_c{i}") for i in range(len(x))]
    g = met.groupBy("feature").agg(F.sum(v * (F.col("_y") - F.col("_mu"))).alias("score"), F.sum(F.col("_w") * v * v).alias("_v"), *[F.sum(F.col("_w") * v * F.col(f"_x{i}")).alias(f"_c{i}") for i in range(len(x))])
    variance = F.col("_v") - sum((_dot(cross, inverse[i]) * cross[i] for i in range(len(x))), F.lit(0.0))
    return g.select("feature", "score", variance.alias("variance"), F.when(variance > 1e-12, F.col("score") / F.sqrt(variance)).alias("z"))


def partial_spearman(df: DataFrame, a: str, b: str, covariates: Sequence[str]) -> float:
    """Spearman correlation of a and b given the covariates: from the inverse of the correlations of ranks."""
    ranked = df.select(a, b, *covariates)
    for c in (a, b):
        ranked = average_ranks(ranked, [], c, f"_r_{c}")
    names = [f"_r_{a}", f"_r_{b}", *covariates]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    got = ranked.agg(*[F.corr(names[i], names[j]) for i, j in pairs]).first()
    r = np.eye(len(names))
    for k, (i, j) in enumerate(pairs):
        r[i, j] = r[j, i] = got[k]
    p = np.linalg.inv(r)
    return float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))


def log_cpm(df: DataFrame, sample: str, count: str) -> DataFrame:
    """Long counts with log2 of counts per million plus one half."""
    size = df.groupBy(sample).agg(F.sum(count).alias("_size"))
    return met_on(df, size, [sample]).withColumn("log_cpm", F.log2(F.col(count) / F.col("_size") * 1e6 + 0.5)).drop("_size")


def standardised(df: DataFrame, group: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """(x - mean) / population standard deviation in the group, zero where it is constant."""
    s = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return met_on(df, s, list(group)).withColumn(name, F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def tmm_factors(df: DataFrame, sample: str, gene: str, count: str, trim_m: float = 0.3, trim_a: float = 0.05, least: int = 100) -> DataFrame:
    """(sample, factor): trimmed mean of M-values over long counts, factors with geometric mean 1.

    The reference is the sample whose upper quartile of counts per library size, over all
    genes of the table (those without a row count zero), is closest to the mean of all
    samples'. Genes enter where both counts are positive and the variance is. Fails if a
    library is empty or a sample has fewer than `least` such genes, before or after trimming.
    """
    cells = checkpoint(df.groupBy(F.col(sample).alias("s"), F.col(gene).alias("g")).agg(F.sum(F.col(count).cast("double")).alias("y")))
    # equal counts of a sample have equal shares, and equal pairs of counts equal M and A: each is taken once, with its number
    counts = checkpoint(cells.groupBy("s", "y").agg(F.count(F.lit(1)).alias("c")))
    size = checkpoint(counts.groupBy("s").agg(F.sum(F.col("y") * F.col("c")).alias("n"), F.sum(F.when(F.col("y") > 0, F.col("c"))).alias("held")))
    genes = cells.agg(F.count_distinct("g").alias("genes"))
    _fail_if(size.where("n <= 0"), "an empty library: sample")
    # the quartile's two neighbours by rank: zeros come first, then the positive shares in order
    placed = met_on(running_sums(counts.where("y > 0"), ["s"], ["y"], {"k": "c"}), size, ["s"]).crossJoin(F.broadcast(genes)).withColumn("p", F.col("y") / F.col("n")).withColumn("at", F.col("genes") - F.col("held") + F.col("k") - 1)
    h = (F.col("genes") - 1) * 0.75
    side = lambda low: F.coalesce(F.max(F.when(F.col("at").between(low, low + F.col("c") - 1), F.col("p"))), F.lit(0.0))
    upper = placed.groupBy("s").agg((side(F.floor(h)) + (F.max(h) - F.floor(F.max(h))) * (side(F.floor(h) + 1) - side(F.floor(h)))).alias("u"))
    ref = checkpoint(upper.join(F.broadcast(upper.agg(F.avg("u").alias("mean")))).orderBy(F.abs(F.col("u") - F.col("mean")), "s").limit(1).select("s"))
    positive = cells.where("y > 0")
    base = positive.join(F.broadcast(ref), "s").select("g", F.col("y").alias("yr"))
    pairs = positive.join(F.broadcast(ref), "s", "left_anti").join(base, "g").groupBy("s", "y", "yr").agg(F.count(F.lit(1)).alias("c"))
    of_ref = size.join(F.broadcast(ref), "s").select(F.col("n").alias("nr"))
    shares = met_on(pairs, size.select("s", "n"), ["s"]).crossJoin(F.broadcast(of_ref)).withColumns({"p": F.col("y") / F.col("n"), "pr": F.col("yr") / F.col("nr")})
    ma = checkpoint(shares.select("s", "c", F.log2(F.col("p") / F.col("pr")).alias("m"), ((F.log2("p") + F.log2("pr")) / 2).alias("a"), ((F.col("n") - F.col("y")) / F.col("n") / F.col("y") + (F.col("nr") - F.col("yr")) / F.col("nr") / F.col("yr")).alias("v")).where("v > 0"))
    k = ma.groupBy("s").agg(F.sum("c").alias("k"))
    ranked = met_on(average_ranks(average_ranks(ma, ["s"], "m", "rm", "c"), ["s"], "a", "ra", "c"), k, ["s"])

    def within(r: str, trim: float) -> Column:
        low = F.floor(F.col("k") * trim) + 1
        return F.col(r).between(low, F.col("k") + 1 - low)

    kept = ranked.where(within("rm", trim_m) & within("ra", trim_a)).groupBy("s").agg((F.sum(F.col("c") * F.col("m") / F.col("v")) / F.sum(F.col("c") / F.col("v"))).alias("f"), F.sum("c").alias("kept"))
    others = checkpoint(size.select("s").join(F.broadcast(ref), "s", "left_anti").join(k, "s", "left").join(kept, "s", "left"))
    _fail_if(others.where(F.least(F.coalesce("k", F.lit(0)), F.coalesce("kept", F.lit(0))) < least), f"fewer than {least} genes: sample")
    raw = others.select("s", "f").union(ref.select("s", F.lit(0.0)))
    return raw.join(F.broadcast(raw.agg(F.avg("f").alias("mean")))).select(F.col("s").alias(sample), F.pow(F.lit(2.0), F.col("f") - F.col("mean")).alias("factor"))


def _fail_if(rows: DataFrame, what: str) -> None:
    bad = rows.limit(1).collect()
    if bad:
        raise ValueError(f"{what} {bad[0][0]}")


def oriented_response(df: DataFrame, category: str, value: str) -> DataFrame:
    """df with `oriented`: the value of positive_up, minus that of positive_down, and for all others the value times the mixture (up - down) / (up + down). Fails without a positive row."""
    up, down = F.count_if(F.col(category) == "positive_up"), F.count_if(F.col(category) == "positive_down")
    n = df.agg(up.alias("_up"), down.alias("_down"))
    _fail_if(n.where("_up + _down = 0"), "no positive row among")
    mixture = (F.col("_up") - F.col("_down")) / (F.col("_up") + F.col("_down"))
    side = F.when(F.col(category) == "positive_up", 1.0).when(F.col(category) == "positive_down", -1.0).otherwise(mixture)
    return df.crossJoin(F.broadcast(n)).withColumn("oriented", side * F.col(value)).drop("_up", "_down")


def oriented_difference(df: DataFrame, group: Sequence[str], category: str, value: str) -> DataFrame:
    """(group, statistic): mean of positives along their direction less the mixture of directions times the mean of negatives; null without either."""
    c, x = F.col(category), F.col(value)
    up, down, negative = (c == k for k in ("positive_up", "positive_down", "negative"))
    g = df.groupBy(*group).agg(F.count_if(up).alias("_u"), F.count_if(down).alias("_d"), F.coalesce(F.sum(F.when(up, x)), F.lit(0.0)).alias("_su"), F.coalesce(F.sum(F.when(down, x)), F.lit(0.0)).alias("_sd"), F.avg(F.when(negative, x)).alias("_m"))
    n = F.col("_u") + F.col("_d")
    return g.select(*group, (F.try_divide(F.col("_su") - F.col("_sd"), n) - F.try_divide(F.col("_u") - F.col("_d"), n) * F.col("_m")).alias("statistic"))


def size_factors(df: DataFrame, sample: str, gene: str, count: str) -> DataFrame:
    """(sample, factor): median ratio to the geometric mean over genes that every sample has."""
    n = df.select(sample).distinct().agg(F.count(F.lit(1)).alias("_k"))
    full = df.where(F.col(count) > 0).groupBy(gene).agg(F.avg(F.ln(count)).alias("_g"), F.count(F.lit(1)).alias("_c")).join(F.broadcast(n)).where("_c = _k").select(gene, "_g")
    return df.where(F.col(count) > 0).join(full, gene).groupBy(sample).agg(F.exp(F.percentile(F.ln(count) - F.col("_g"), 0.5)).alias("factor"))


def balanced_weights(df: DataFrame, cells: Sequence[str], per_cell: float) -> DataFrame:
    n = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    return met_on(df, n, list(cells)).withColumn("weight", per_cell / F.col("_n")).drop("_n")


def log_factorials(df: DataFrame, n: int) -> DataFrame:
    """(i, value): ln i! for 0..n as a table, for engines and places without a gamma function."""
    each = df.sparkSession.range(1, n + 1).select(F.col("id").alias("i"), F.ln("id").alias("x"))
    return running_sums(each, [], ["i"], {"value": "x"}).select("i", "value").union(df.sparkSession.range(1).select("id", F.lit(0.0)))
