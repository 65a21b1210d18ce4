"""Queries over ranking and classification metrics; labels are `labels.quality`, scores come from a hash and lean on the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators import metrics
from weft.plans.registry import query, table

_P = "('0x' || substr(sha256('{0}|' || doc_id), 1, 8))::BIGINT"
_S = f"WITH s AS (SELECT doc_id, lang, quality AS y, ({_P.format('a')} % 200 + 60 * quality) / 260.0 AS p, ({_P.format('b')} % 200 + 60 * quality) / 260.0 AS q FROM documents JOIN labels USING (doc_id))"


def scored(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    s = lambda seed: (hashing.bucket(200, F.lit(seed), F.col("doc_id").cast("string")) + 60 * F.col("y")) / 260.0
    return x.select("doc_id", "lang", "y", s("a").alias("p"), s("b").alias("q"))


def _r(c, n=8):
    return F.round(c, n).alias(c)


@query("e1_average_precision", _S + ", g AS (SELECT lang, p, sum(y) AS tp, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY lang) AS t FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC)) SELECT lang, round(sum(tp / t * ctp / cn), 8) + 0.0 AS auprc FROM c GROUP BY lang")
def _(spark, d):
    return metrics.average_precision(scored(spark, d), ["lang"], "p", "y").select("lang", _r("auprc"))


@query("e3_auroc", _S + ", r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS k FROM s) SELECT lang, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) + 0.0 AS auroc FROM r GROUP BY lang")
def _(spark, d):
    return metrics.auroc(scored(spark, d), ["lang"], "p", "y").select("lang", _r("auroc"))


@query(
    "e4_threshold_metrics",
    _S + """, c AS (SELECT lang, count(*) FILTER (WHERE p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0)::DOUBLE AS tn FROM s GROUP BY lang)
SELECT lang, (tp + fp + fn + tn)::BIGINT AS n, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 8) + 0.0 AS mcc, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 8) + 0.0 AS balanced_accuracy FROM c""",
)
def _(spark, d):
    return metrics.threshold_metrics(scored(spark, d), ["lang"], "p", "y", 0.5).select("lang", "n", _r("mcc"), _r("balanced_accuracy"))


@query(
    "e5_best_threshold",
    _S + """, g AS (SELECT lang, p, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM s GROUP BY ALL),
c AS (SELECT lang, p, sum(tp) OVER w AS tp, sum(n) OVER w - sum(tp) OVER w AS fp, sum(tp) OVER (PARTITION BY lang) AS pos, sum(n) OVER (PARTITION BY lang) AS t FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC)),
m AS (SELECT lang, p, round(coalesce((tp * (t - pos - fp) - fp * (pos - tp)) / nullif(sqrt((tp + fp) * pos * (t - pos) * (t - tp - fp)), 0), 0), 12) AS mcc FROM c)
SELECT lang, arg_max(p, (mcc, p)) AS threshold, round(max(mcc), 8) + 0.0 AS mcc FROM m GROUP BY lang""",
)
def _(spark, d):
    return metrics.best_mcc_threshold(scored(spark, d), ["lang"], "p", "y").select("lang", "threshold", _r("mcc"))


@query("e6_calibration_error", _S + ", b AS (SELECT lang, least(floor(p * 15), 14) AS k, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s GROUP BY ALL) SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 8) + 0.0 AS ece FROM b GROUP BY lang")
def _(spark, d):
    return metrics.calibration_error(scored(spark, d), ["lang"], "p", "y").select("lang", _r("ece"))


@query("e7_top_k_enrichment", _S + ", r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS place, sum(y) OVER (PARTITION BY lang) AS k, count(*) OVER (PARTITION BY lang) AS n FROM s) SELECT lang, max(k)::BIGINT AS k, CASE WHEN max(k) > 0 AND max(k) < max(n) THEN round(sum(y) FILTER (WHERE place <= k) / max(k) / (max(k) / max(n)), 8) + 0.0 END AS enrichment FROM r GROUP BY lang")
def _(spark, d):
    return metrics.top_k_enrichment(scored(spark, d), ["lang"], "p", "y", "doc_id").select("lang", "k", _r("enrichment"))


@query(
    "e8_agreement",
    _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY q DESC, doc_id) AS b FROM s),
g AS (SELECT lang, count(*) AS n, corr(p, q) AS c, avg(abs(p - q)) AS m, count(*) FILTER (WHERE a <= 20 AND b <= 20) AS o FROM r GROUP BY lang)
SELECT lang, round(c, 8) + 0.0 AS pearson, round(m, 8) + 0.0 AS mae, o AS overlap, round(o / (2 * least(20, n) - o), 8) + 0.0 AS jaccard, round((o - least(20, n) ** 2 / n) / nullif(least(20, n) - least(20, n) ** 2 / n, 0), 8) + 0.0 AS kuncheva FROM g""",
)
def _(spark, d):
    return metrics.agreement(scored(spark, d), ["lang"], "p", "q", "doc_id", 20).select("lang", _r("pearson"), _r("mae"), "overlap", _r("jaccard"), _r("kuncheva"))


@query("e9_spearman", _S + ", r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY q) + (count(*) OVER (PARTITION BY lang, q) - 1) / 2 AS b FROM s) SELECT lang, round(corr(a, b), 8) + 0.0 AS spearman FROM r GROUP BY lang")
def _(spark, d):
    return metrics.spearman(scored(spark, d), ["lang"], "p", "q").select("lang", _r("spearman"))
