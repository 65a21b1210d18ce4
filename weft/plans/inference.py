"""Queries over resampling, tests, multiplicity and meta-analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.hashing import bucket
from weft.operators import expression, ordered, replicates, resampling, statistics
from weft.plans.metrics import _S, scored
from weft.plans.registry import query, table


def _r(c, n=8):
    return F.round(c, n).alias(c)


#: Draws of a bootstrap, permutations of a test, shuffles of a signature's labels.
DRAWS, PERMUTATIONS, SHUFFLES = 2000, 10_000, 100
_H = "('0x' || substr(sha256({}), 1, 8))::BIGINT"


def _draws(block, source, seed, reps, strata=()):
    """SQL for u (numbered blocks) and w (weights by replicate)."""
    key = "".join(f"{s} || '|' || " for s in strata)
    cols = "".join(f"{s}, " for s in strata)
    part = f"PARTITION BY {', '.join(strata)} " if strata else ""
    same = "".join(f" AND x.{s} = u.{s}" for s in strata)
    u_cols = "".join(f"u.{s}, " for s in strata)
    return f"""u AS (SELECT {cols}{block}, row_number() OVER ({part}ORDER BY {block}) - 1 AS i, count(*) OVER ({part.strip()}) AS n FROM (SELECT DISTINCT {cols}{block} FROM {source})),
x AS (SELECT {cols}rep, {_H.format(f"'{seed}|' || {key}rep || '|' || i")} % n AS pick FROM u, range(1, {reps + 1}) t(rep)),
w AS (SELECT {u_cols}rep, u.{block}, count(*) AS weight FROM x JOIN u ON x.pick = u.i{same} GROUP BY ALL)"""


_B = _S.replace("SELECT doc_id, lang,", "SELECT doc_id, doc_id // 10 AS block, source, lang,", 1)


@query(
    "r1_block_bootstrap",
    _B + ", " + _draws("block", "s", "r1", DRAWS) + """, g AS (SELECT rep, p, sum(weight * y)::DOUBLE AS tp, sum(weight)::DOUBLE AS n FROM s JOIN w USING (block) GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn, sum(tp) OVER (PARTITION BY rep) AS t FROM g WINDOW o AS (PARTITION BY rep ORDER BY p DESC)) SELECT rep AS replicate, round(sum(tp / t * ctp / cn), 8) + 0.0 AS auprc FROM c GROUP BY rep""",
)
def _(spark, d):
    s = scored(spark, d).withColumn("block", F.floor(F.col("doc_id") / 10))
    return replicates.average_precision_bootstrap(s, replicates.drawn_weights(s, "block", DRAWS, "r1"), ["block"], "p", "y", DRAWS).select("replicate", _r("auprc"))


@query(
    "r2_label_stratified_bootstrap",
    _B + ", " + _draws("doc_id", "s", "r2", DRAWS, ["y"]) + " SELECT rep AS replicate, sum(weight)::BIGINT AS n, round(sum(weight * y * p) / sum(weight * y) - sum(weight * (1 - y) * p) / sum(weight * (1 - y)), 8) + 0.0 AS gap FROM s JOIN w USING (y, doc_id) GROUP BY rep",
)
def _(spark, d):
    s = scored(spark, d)
    y, p = F.col("y"), F.col("p")
    g = replicates.drawn_sums(s, "doc_id", DRAWS, "r2", {"n": F.lit(1), "n1": y, "s1": y * p, "n0": 1 - y, "s0": (1 - y) * p}, ["y"])
    return g.select("replicate", F.col("n").cast("long").alias("n"), F.round(resampling.mean_gap(), 8).alias("gap"))


@query(
    "r3_block_mean_difference",
    _B + ", " + _draws("source", "s", "r3", DRAWS) + " SELECT rep AS replicate, round(sum(weight * y * p) / sum(weight * y) - sum(weight * (1 - y) * p) / sum(weight * (1 - y)), 8) + 0.0 AS difference FROM s JOIN w USING (source) GROUP BY rep HAVING sum(weight * y) > 0 AND sum(weight * (1 - y)) > 0",
)
def _(spark, d):
    s = scored(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return resampling.mean_difference_bootstrap(s, "source", "y", "p", DRAWS, "r3").select(F.col("replicate").cast("long").alias("replicate"), _r("difference"))


@query("r5_cell_bootstrap", "WITH s AS (SELECT n_name AS cell, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), " + _draws("cell", "s", "r5", DRAWS) + ", m AS (SELECT rep, sum(weight * v) / sum(weight) AS m FROM s JOIN w USING (cell) GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.5), 6) + 0.0 AS median, round(quantile_cont(m, 0.975), 6) + 0.0 AS high, round(avg((m > 4500)::INT), 6) + 0.0 AS above FROM m")
def _(spark, d):
    s = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("cell")).agg(F.avg("c_acctbal").alias("v"))
    m = resampling.mean_bootstrap(s, "cell", "v", DRAWS, "r5")
    return m.agg(*[F.round(F.percentile("mean", q), 6).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))], F.round(F.avg((F.col("mean") > 4500).cast("int")), 6).alias("above"))


@query(
    "r6_hierarchical_median",
    "WITH s AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal AS v FROM customer), "
    + _draws("g", "s", "r6:groups", DRAWS).replace("u AS", "ug AS").replace("FROM u,", "FROM ug,").replace("u ON", "ug u ON").replace("x AS", "xg AS").replace("FROM x ", "FROM xg x ").replace("w AS", "wg AS", 1)
    + ", " + _draws("id", "s", "r6:rows", DRAWS, ["g"]) + ", z AS (SELECT w.rep, s.v, unnest(range(0, w.weight * wg.weight)) AS k FROM s JOIN w USING (g, id) JOIN wg ON wg.g = s.g AND wg.rep = w.rep) SELECT rep AS replicate, round(quantile_cont(v, 0.5), 6) + 0.0 AS median FROM z GROUP BY rep",
)
def _(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return resampling.hierarchical_median(s, "g", "id", "v", DRAWS, "r6").select(F.col("replicate").cast("long").alias("replicate"), _r("median", 6))


@query(
    "r8_stratified_permutation",
    _B + f""", a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM s), b AS (SELECT source, doc_id, p, rep, row_number() OVER (PARTITION BY source, rep ORDER BY sha256('r8|' || rep || '|' || doc_id), doc_id) AS i FROM s, range(1, {PERMUTATIONS + 1}) t(rep)),
m AS (SELECT rep, avg(b.p) FILTER (WHERE a.y = 1) - avg(b.p) FILTER (WHERE a.y = 0) AS t FROM b JOIN a USING (source, i) GROUP BY rep), o AS (SELECT avg(p) FILTER (WHERE y = 1) - avg(p) FILTER (WHERE y = 0) AS t FROM s)
SELECT count(*) AS replicates, round(avg(m.t), 8) + 0.0 AS null_mean, round(max(o.t), 8) + 0.0 AS observed, round((1 + count(*) FILTER (WHERE round(m.t, 9) >= round(o.t, 9))) / (1 + count(*)), 8) + 0.0 AS p FROM m, o""",
)
def _(spark, d):
    s = scored(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    gap = lambda y: F.avg(F.when(F.col(y) == 1, F.col("p"))) - F.avg(F.when(F.col(y) == 0, F.col("p")))
    null = resampling.permutation_totals(s, ["source"], "doc_id", "y", "p", PERMUTATIONS, "r8").select(resampling.mean_gap().alias("t"))
    both = null.join(F.broadcast(s.agg(gap("y").alias("o"))))
    return both.agg(F.count(F.lit(1)).alias("replicates"), F.round(F.avg("t"), 8).alias("null_mean"), F.round(F.max("o"), 8).alias("observed"), F.round(resampling.empirical_p(F.round("t", 9), F.round("o", 9)), 8).alias("p"))


_DRAWN = "WITH v AS (SELECT event_type AS arm, event_id, value - 50 AS x FROM events)"


@query(
    "r14_interval_summary",
    _DRAWN + " SELECT arm, round(quantile_cont(x, 0.025), 6) + 0.0 AS low, round(quantile_cont(x, 0.5), 6) + 0.0 AS median, round(quantile_cont(x, 0.975), 6) + 0.0 AS high, round(avg((x > 0)::INT), 8) + 0.0 AS above, round(avg((x >= 30)::INT), 8) + 0.0 AS above_rope, quantile_cont(x, 0.05) > -30 AND quantile_cont(x, 0.95) < 30 AS equivalent FROM v GROUP BY arm",
)
def _(spark, d):
    v = table(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("value") - 50).alias("x"))
    return resampling.summary(v, ["arm"], "x", 30.0).select("arm", _r("low", 6), _r("median", 6), _r("high", 6), _r("above"), _r("above_rope"), "equivalent")


@query("r15_leave_one_out", "WITH t AS (SELECT count(value) AS n, sum(value) AS s FROM events) SELECT user_id AS left_out, round((max(t.s) - sum(value)) / (max(t.n) - count(value)), 6) + 0.0 AS mean FROM events, t GROUP BY user_id")
def _(spark, d):
    return resampling.leave_one_out(table(spark, d, "events"), "user_id", "value").select("left_out", _r("mean", 6))


@query("r17_direction_stability", "SELECT c_mktsegment, round(avg((c_acctbal > 4000)::INT), 8) + 0.0 AS share, avg((c_acctbal > 4000)::INT) >= 0.5 AS robust FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("odds", F.col("c_acctbal") / 4000)
    return resampling.stability(c, ["c_mktsegment"], "odds", 0.5).select("c_mktsegment", _r("share"), "robust")


@query("r18_derived_contrast", "SELECT o_custkey, round(least(max(o_totalprice) - avg(o_totalprice), avg(o_totalprice) - min(o_totalprice)), 6) + 0.0 AS delta FROM orders GROUP BY 1")
def _(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.least(F.max(p) - F.avg(p), F.avg(p) - F.min(p)), 6).alias("delta"))


_PV = f"WITH v AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE ({_H.format(chr(39) + 'p|' + chr(39) + ' || p_partkey')} % 1000 + 1) / 1001.0 END AS p FROM part)"


@query("t1_benjamini_hochberg", _PV + ", k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM v WHERE p IS NOT NULL) SELECT p_partkey, round(least(1, min(p * n / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 10) + 0.0 AS q FROM k UNION ALL SELECT p_partkey, NULL FROM v WHERE p IS NULL")
def _(spark, d):
    v = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 7 != 0, (bucket(1000, F.lit("p"), F.col("p_partkey").cast("string")) + 1) / 1001.0).alias("p"))
    return ordered.adjusted_p(v, ["p_brand"], "p", "p_partkey").select("p_partkey", F.round("q", 10).alias("q"))


_TERMS = """WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE p_size <= 15) AS marked FROM part), t AS (SELECT p_type AS term, count(*) AS drawn, count(*) FILTER (WHERE p_size <= 15) AS k FROM part GROUP BY 1)"""


def _terms(spark, d):
    small = F.count_if(F.col("p_size") <= 15)
    p = table(spark, d, "part")
    t = p.groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("drawn"), small.alias("k"))
    return t.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"), small.alias("marked"))))


@query(
    "t2_hypergeometric_tail",
    _TERMS + """, x AS (SELECT *, unnest(range(k, least(marked, drawn) + 1)) AS i FROM t, n)
SELECT term, round(sum(exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1) - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1))), 8) + 0.0 AS p FROM x GROUP BY term""",
)
def _(spark, d):
    return _terms(spark, d).select("term", F.round(statistics.hypergeometric_tail()("k", "total", "marked", "drawn"), 8).alias("p"))


@query(
    "t3_fisher_exact",
    _TERMS + """, x AS (SELECT *, unnest(range(greatest(0, drawn + marked - total), least(marked, drawn) + 1)) AS i FROM t, n),
e AS (SELECT term, k, i, exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1) - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)) AS pr FROM x),
o AS (SELECT term, max(pr) FILTER (WHERE i = k) AS obs FROM e GROUP BY term)
SELECT e.term, round(least(1, sum(pr) FILTER (WHERE pr <= obs * (1 + 1e-7))), 8) + 0.0 AS p, round((max(k) + 0.5) * (max(n.total - marked - drawn + k) + 0.5) / ((max(drawn - k) + 0.5) * (max(marked - k) + 0.5)), 8) + 0.0 AS odds FROM e JOIN o USING (term) JOIN (SELECT term, drawn FROM t) USING (term), n GROUP BY e.term""",
)
def _(spark, d):
    t = _terms(spark, d)
    a, b, c = F.col("k"), F.col("drawn") - F.col("k"), F.col("marked") - F.col("k")
    e = F.col("total") - F.col("marked") - F.col("drawn") + F.col("k")
    return t.select("term", F.round(statistics.fisher_two_sided()(a, b, c, e), 8).alias("p"), F.round(statistics.odds_ratio(a, b, c, e), 8).alias("odds"))


@query("t5_fisher_combined", f"WITH v AS (SELECT doc_id, ({_H.format(chr(39) + 'x|' + chr(39) + ' || doc_id')} % 1000 + 1) / 1001.0 AS p, ({_H.format(chr(39) + 'y|' + chr(39) + ' || doc_id')} % 1000 + 1) / 1001.0 AS q FROM documents) SELECT doc_id, round(exp(ln(p) + ln(q)) * (1 - ln(p) - ln(q)), 9) + 0.0 AS combined FROM v")
def _(spark, d):
    p = lambda s: (bucket(1000, F.lit(s), F.col("doc_id").cast("string")) + 1) / 1001.0
    return table(spark, d, "documents").select("doc_id", F.round(statistics.fisher_combined(p("x"), p("y")), 9).alias("combined"))


_ST = "WITH v AS (SELECT l_suppkey AS gene, l_returnflag || l_linestatus AS study, avg(l_discount) - 0.05 AS b, stddev_samp(l_discount) / sqrt(count(*)) AS e FROM lineitem GROUP BY ALL HAVING count(*) > 2)"


def _studies(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("study"))
    return g.agg((F.avg("l_discount") - 0.05).alias("b"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("e"), F.count(F.lit(1)).alias("k")).where("k > 2")


@query(
    "t9_fixed_effect",
    _ST + ", m AS (SELECT gene, count(*) AS studies, sum(1 / (e * e)) AS w, sum(b / (e * e)) AS wb, sum(b * b / (e * e)) AS wbb FROM v GROUP BY gene), q AS (SELECT *, greatest(0, wbb - wb * wb / w) AS q FROM m) SELECT gene, studies, round(wb / w, 8) + 0.0 AS beta, round(sqrt(1 / w), 8) + 0.0 AS se, round(wb / sqrt(w), 6) + 0.0 AS z, round(q, 6) + 0.0 AS q, round(CASE WHEN q > 0 THEN greatest(0, (q - (studies - 1)) / q) ELSE 0 END, 6) + 0.0 AS i2 FROM q",
)
def _(spark, d):
    return statistics.fixed_effect(_studies(spark, d), ["gene"], "b", "e").select("gene", "studies", _r("beta"), _r("se"), _r("z", 6), _r("q", 6), _r("i2", 6))


@query(
    "t10_random_effects",
    _ST + """, m AS (SELECT gene, count(*) AS k, sum(1 / (e * e)) AS w, sum(1 / (e * e * e * e)) AS ww, sum(b / (e * e)) AS wb, sum(b * b / (e * e)) AS wbb FROM v GROUP BY gene),
t AS (SELECT gene, k, coalesce(greatest(0, (wbb - wb * wb / w - (k - 1)) / nullif(w - ww / w, 0)), 0) AS tau2 FROM m),
r AS (SELECT gene, k, tau2, sum(1 / (e * e + tau2)) AS s, sum(b / (e * e + tau2)) AS sb, count(*) FILTER (WHERE b > 0) AS up, count(*) FILTER (WHERE b < 0) AS down FROM v JOIN t USING (gene) GROUP BY ALL)
SELECT gene, k AS studies, round(tau2, 8) + 0.0 AS tau2, round(sb / s, 8) + 0.0 AS beta, round(sqrt(1 / s), 8) + 0.0 AS se, round(sb / s - 1.6448536269514722 * sqrt(1 / s), 8) + 0.0 AS low90, round(CASE WHEN sb > 0 THEN up ELSE down END / k, 8) + 0.0 AS direction FROM r""",
)
def _(spark, d):
    return statistics.random_effects(_studies(spark, d), ["gene"], "b", "e").select("gene", "studies", _r("tau2"), _r("beta"), _r("se"), _r("low90"), _r("direction"))


@query(
    "t12_robust_labels",
    "WITH v AS (SELECT l_partkey AS gene, (l_quantity - 25) / 20 AS fx, l_discount AS q, (l_quantity - 25) / 20 - l_tax AS lo, (l_quantity - 25) / 20 + l_tax AS hi FROM lineitem), g AS (SELECT gene, count(*) AS studies, greatest(count(*) FILTER (WHERE q <= 0.10 AND fx >= 0.75), count(*) FILTER (WHERE q <= 0.10 AND fx <= -0.75)) AS supporting, count(*) FILTER (WHERE lo > -0.75 AND hi < 0.75) AS equivalent FROM v GROUP BY gene) SELECT *, CASE WHEN supporting >= 2 / 3 * studies THEN 'positive' WHEN equivalent >= 2 / 3 * studies AND supporting = 0 THEN 'negative' ELSE 'ambiguous' END AS label FROM g",
)
def _(spark, d):
    fx = (F.col("l_quantity") - 25) / 20
    v = table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), fx.alias("fx"), F.col("l_discount").alias("q"), (fx - F.col("l_tax")).alias("lo"), (fx + F.col("l_tax")).alias("hi"))
    return statistics.robust_labels(v, "gene", "fx", "q", "lo", "hi")


@query("m6_log_cpm", "WITH c AS (SELECT l_suppkey AS s, l_partkey AS g, sum(l_quantity) AS y FROM lineitem GROUP BY ALL) SELECT s, g, round(log2(y / sum(y) OVER (PARTITION BY s) * 1e6 + 0.5), 6) + 0.0 AS log_cpm FROM c")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("g")).agg(F.sum("l_quantity").alias("y"))
    return statistics.log_cpm(c, "s", "y").select("s", "g", _r("log_cpm", 6))


@query("m7_standardised", "SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def _(spark, d):
    return statistics.standardised(table(spark, d, "events"), ["event_type"], "value").select("event_id", _r("z", 6))


@query("t13_ols_hc3")
def _(spark, d):
    e = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return statistics.ols_hc3(e, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("term", _r("beta", 4), _r("se", 4))


@query("t15_partial_spearman")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    r = statistics.partial_spearman(li, "l_extendedprice", "l_quantity", ["l_discount", "l_tax"])
    return spark.createDataFrame([(round(r, 8),)], "partial_spearman double")


@query("t16_clopper_pearson")
def _(spark, d):
    g = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ci", statistics.clopper_pearson()("k", "n")).select("lang", "k", "n", F.round("ci.low", 8).alias("low"), F.round("ci.high", 8).alias("high"))


@query("t17_tmm_factors")
def _(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("s"), (F.col("l_partkey") * 4 + F.col("l_linenumber") % 4).alias("g"), F.col("l_quantity").alias("y"))
    return statistics.tmm_factors(c, "s", "g", "y").select("s", _r("factor", 8))


@query("t7_t8_score_tests")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.ln(F.col("n_chars") + 1)).alias("size"), "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    beta = statistics.logistic_null(rows, "quality", ["size"])
    words = rows.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("feature")).where("length(feature) BETWEEN 2 AND 4").groupBy("doc_id", "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return statistics.score_tests(rows, words, "doc_id", "quality", ["size"], beta).select("feature", _r("score", 6), _r("z", 6))


@query("t11_negative_binomial")
def _(spark, d):
    """Parts as genes, suppliers modulo 8 as samples, odd ones the second condition; counts are quantities sold."""
    c = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("s"), (F.col("l_partkey") % 500).alias("g")).agg(F.sum("l_quantity").cast("long").alias("n"))
    samples = c.select("s").distinct().withColumn("c", F.col("s") % 2)
    return expression.wald_tests(c, samples, "s", "g", "n", "c").select("g", _r("base_mean", 6), _r("dispersion", 6), _r("log2_fold", 6), _r("se", 6), _r("p", 6))
