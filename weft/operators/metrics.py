"""Ranking and classification metrics by group, with ties treated as one threshold.

Rows are first summed by group and score, so later steps see distinct scores only; the
cumulative counts come from range-partitioned sums (weft.operators.ordered), so a group
of any size is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.ordered import average_ranks, met_on, row_numbers, running_sums


def _by_score(df: DataFrame, group: Sequence[str], score: str, label: str, weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return df.groupBy(*group, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("tp"), F.sum(w).alias("n"))


def average_precision(df: DataFrame, group: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(group, auprc); null for a group without positives."""
    g = _by_score(df, group, score, label, weight).where("n > 0")
    c = running_sums(g, list(group), [F.desc("score")], {"ctp": "tp", "cn": "n"})
    return c.groupBy(*group).agg(F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp")).alias("auprc"))


def auroc(df: DataFrame, group: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(group, auroc); null for a group with one class."""
    g = _by_score(df, group, score, label, weight).withColumn("fp", F.col("n") - F.col("tp"))
    c = running_sums(g, list(group), ["score"], {"below": "fp"})
    return c.groupBy(*group).agg(F.try_divide(F.sum(F.col("tp") * (F.col("below") - F.col("fp") / 2)), F.sum("tp") * F.sum("fp")).alias("auroc"))


def _mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.coalesce(F.try_divide(d(tp) * tn - d(fp) * fn, F.sqrt((d(tp) + fp) * (d(tp) + fn) * (d(tn) + fp) * (d(tn) + fn))), F.lit(0.0))


def threshold_metrics(df: DataFrame, group: Sequence[str], score: str, label: str, threshold: float) -> DataFrame:
    """(group, n, mcc, balanced_accuracy) of score >= threshold."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*group).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*group, (tp + fp + fn + tn).alias("n"), _mcc(tp, fp, fn, tn).alias("mcc"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"))


def best_mcc_threshold(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """(group, threshold, mcc): the threshold with the largest MCC, the highest of equal ones."""
    g = _by_score(df, group, score, label, None)
    c = running_sums(g, list(group), [F.desc("score")], {"ctp": "tp", "cn": "n"})
    total = g.groupBy(*group).agg(F.sum("tp").alias("_p"), F.sum("n").alias("_t"))
    c = met_on(c, total, list(group))
    fp = F.col("cn") - F.col("ctp")
    m = _mcc(F.col("ctp"), fp, F.col("_p") - F.col("ctp"), F.col("_t") - F.col("_p") - fp)
    return c.withColumn("mcc", F.round(m, 12)).groupBy(*group).agg(F.max(F.struct("mcc", "score")).alias("b")).select(*group, F.col("b.score").alias("threshold"), "b.mcc")


def calibration_error(df: DataFrame, group: Sequence[str], probability: str, label: str, bins: int = 15) -> DataFrame:
    """(group, ece): mean gap between confidence and accuracy over equal-width bins, weighted by size."""
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    b = df.groupBy(*group, place.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg(label).alias("y"))
    return b.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def top_k_enrichment(df: DataFrame, group: Sequence[str], score: str, label: str, ident: str) -> DataFrame:
    """(group, k, enrichment): the share of positives among the k best, k the number of positives, over their share in all; null with one class."""
    size = df.groupBy(*group).agg(F.sum(label).cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    placed = row_numbers(df, list(group), [F.desc(score), ident], "_place")
    met = met_on(placed, size, list(group))
    hit = met.groupBy(*group, "k", "n").agg(F.sum(F.when(F.col("_place") <= F.col("k"), F.col(label)).otherwise(0)).alias("h"))
    return hit.select(*group, "k", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), (F.col("h") / F.col("k")) / (F.col("k") / F.col("n"))).alias("enrichment"))


def spearman(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """(group, spearman) with average ranks."""
    ranked = average_ranks(average_ranks(df, list(group), a, "_ra"), list(group), b, "_rb")
    return ranked.groupBy(*group).agg(F.corr("_ra", "_rb").alias("spearman"))


def agreement(df: DataFrame, group: Sequence[str], a: str, b: str, ident: str, k: int) -> DataFrame:
    """(group, pearson, mae, overlap, jaccard, kuncheva) of two scores; the last three compare their k best."""
    first = row_numbers(df, list(group), [F.desc(a), ident], "_pa")
    both = row_numbers(first, list(group), [F.desc(b), ident], "_pb")
    g = both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.count_if((F.col("_pa") <= k) & (F.col("_pb") <= k)).alias("overlap"))
    kk = F.least(F.lit(k), F.col("n")).cast("double")
    expected = kk * kk / F.col("n")
    return g.select(*group, "pearson", "mae", "overlap", (F.col("overlap") / (2 * kk - F.col("overlap"))).alias("jaccard"), F.try_divide(F.col("overlap") - expected, kk - expected).alias("kuncheva"))
