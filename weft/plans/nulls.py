"""Queries over permutation nulls, assignments and control windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.functions import sequence as seq
from weft.operators import graph, ordered, replicates, resampling, shuffles, statistics, vectors
from weft.plans.inference import _B, DRAWS, PERMUTATIONS, SHUFFLES, _draws
from weft.plans.metrics import scored
from weft.plans.registry import query, table
from weft.plans.sequence import _D, dna
from weft.plans.structure import _CKA


@query(
    "r4_bootstrap_partial_spearman",
    "WITH s AS (SELECT c_custkey AS id, c_nationkey AS block, c_acctbal AS a, length(c_name) + c_custkey % 13 AS b, c_custkey % 7 AS c FROM customer), " + _draws("block", "s", "r4", DRAWS) + """, z AS (SELECT rep, a, b, c, unnest(range(0, weight)) AS k FROM s JOIN w USING (block)),
r AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY a) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2 AS a, rank() OVER (PARTITION BY rep ORDER BY b) + (count(*) OVER (PARTITION BY rep, b) - 1) / 2 AS b, rank() OVER (PARTITION BY rep ORDER BY c) + (count(*) OVER (PARTITION BY rep, c) - 1) / 2 AS c FROM z),
m AS (SELECT rep, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r GROUP BY rep) SELECT rep AS replicate, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 7) + 0.0 AS partial FROM m""",
)
def _(spark, d):
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_acctbal").alias("a"), (F.length("c_name") + k % 13).alias("b"), (k % 7).alias("c"))
    m = resampling.spearman_block_bootstrap(s, "block", ["a", "b", "c"], DRAWS, "r4")
    return m.select(F.col("replicate").cast("long").alias("replicate"), F.round(resampling.partial_of_three(F.col("r_a_b"), F.col("r_a_c"), F.col("r_b_c")), 7).alias("partial"))


@query("r7_category_bootstrap", _B + ", " + _draws("doc_id", "s", "r7", DRAWS, ["lang"]) + " SELECT rep AS replicate, round(sum(weight * y) / sum(weight), 8) + 0.0 AS proportion FROM s JOIN w USING (lang, doc_id) GROUP BY rep")
def _(spark, d):
    s = scored(spark, d)
    g = replicates.drawn_sums(s, "doc_id", DRAWS, "r7", {"k": F.col("y"), "n": F.lit(1)}, ["lang"])
    return g.select("replicate", F.round(F.col("k") / F.col("n"), 8).alias("proportion"))


@query(
    "r9_term_permutation",
    f"""WITH s AS (SELECT s_suppkey AS id, s_nationkey // 5 AS g, s_nationkey AS term, (s_acctbal > 5000)::INT AS y FROM supplier), a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS i FROM s),
b AS (SELECT g, term, rep, row_number() OVER (PARTITION BY g, rep ORDER BY sha256('r9|' || rep || '|' || id), id) AS i FROM s, range(1, {PERMUTATIONS + 1}) t(rep)),
n AS (SELECT rep, b.term, sum(a.y) AS k, count(*) AS drawn FROM b JOIN a USING (g, i) GROUP BY ALL) SELECT rep AS replicate, round(max(k / drawn), 8) + 0.0 AS top, max(k)::BIGINT AS most FROM n GROUP BY rep""",
)
def _(spark, d):
    k = F.col("s_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(k / 5).alias("g"), k.alias("term"), (F.col("s_acctbal") > 5000).cast("int").alias("y"))
    null = resampling.permuted_term_counts(s, ["g"], "id", "term", "y", PERMUTATIONS, "r9")
    return null.groupBy("replicate").agg(F.round(F.max(F.col("k") / F.col("drawn")), 8).alias("top"), F.max("k").alias("most"))


@query("r10_label_shuffle", _B + f", a AS (SELECT y, row_number() OVER (ORDER BY doc_id) AS i FROM s), b AS (SELECT p, rep, row_number() OVER (PARTITION BY rep ORDER BY sha256('r10|' || rep || '|' || doc_id), doc_id) AS i FROM s, range(1, {SHUFFLES + 1}) t(rep)) SELECT rep AS replicate, round(corr(a.y, b.p), 8) + 0.0 AS r FROM b JOIN a USING (i) GROUP BY rep")
def _(spark, d):
    s = scored(spark, d)
    return resampling.permuted_labels(s, [], "doc_id", "y", SHUFFLES, "r10").join(s.select("doc_id", "p"), "doc_id").groupBy(F.col("replicate").cast("long").alias("replicate")).agg(F.round(F.corr("permuted", "p"), 8).alias("r"))


def words_of_labelled(spark, d):
    """Labelled documents with a predictor, and how often they hold each short word."""
    rows = table(spark, d, "documents").select("doc_id", (F.ln(F.col("n_chars") + 1)).alias("size"), "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    words = rows.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("feature")).where("length(feature) BETWEEN 2 AND 4").groupBy("doc_id", "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.drop("text"), words


@query("r10_refitted_null")
def _(spark, d):
    rows, words = words_of_labelled(spark, d)
    z = shuffles.shuffled_scores(rows, words, "doc_id", "quality", ["size"], SHUFFLES, "r10")
    return shuffles.null_extremes(z, SHUFFLES, 3.0).select("replicate", F.round("max_abs_z", 6).alias("max_abs_z"), "n_beyond")


@query(
    "r12_fixed_count_labels",
    f"WITH s AS (SELECT s_suppkey AS id, s_nationkey AS g, (s_acctbal > 5000)::INT AS y FROM supplier), k AS (SELECT g, sum(y) AS k FROM s GROUP BY g), c AS (SELECT g, id, rep, row_number() OVER (PARTITION BY g, rep ORDER BY sha256('r12|' || rep || '|' || id), id) AS i FROM s, range(1, {PERMUTATIONS + 1}) t(rep)) SELECT rep AS replicate, count(*) AS chosen, sum(id)::BIGINT AS ids FROM c JOIN k USING (g) WHERE i <= k GROUP BY rep",
)
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), (F.col("s_acctbal") > 5000).cast("int").alias("y"))
    c = resampling.chosen_sums(s, ["g"], "id", "y", "id", PERMUTATIONS, "r12")
    return c.where("chosen > 0").select("replicate", "chosen", F.col("total").cast("long").alias("ids"))


@query(
    "r16_leave_one_out_enrichment",
    """WITH s AS (SELECT p_brand AS b, p_type AS term, (p_size <= 15)::INT AS y FROM part), l AS (SELECT DISTINCT b AS left_out FROM s),
x AS (SELECT left_out, term, sum(y) AS k, count(*) AS drawn FROM l JOIN s ON b <> left_out GROUP BY ALL), t AS (SELECT left_out, sum(y) AS marked, count(*) AS total FROM l JOIN s ON b <> left_out GROUP BY 1)
SELECT left_out, term, k::BIGINT AS k, drawn, round((k + 0.5) * (total - marked - drawn + k + 0.5) / ((drawn - k + 0.5) * (marked - k + 0.5)), 8) + 0.0 AS odds FROM x JOIN t USING (left_out)""",
)
def _(spark, d):
    s = table(spark, d, "part").select("p_brand", F.col("p_type").alias("term"), (F.col("p_size") <= 15).cast("int").alias("y"))
    e = resampling.leave_one_out_enrichment(s, "p_brand", "term", "y")
    k, n, m, t = (F.col(c) for c in ("k", "drawn", "marked", "total"))
    return e.select("left_out", "term", "k", "drawn", F.round(statistics.odds_ratio(k, n - k, m - k, t - m - n + k), 8).alias("odds"))


@query("r11_assigned_controls")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("control_id"), F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 8).alias("m"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 8).alias("m"))
    return resampling.assigned_controls_within(t, c, ["k", "m"], SHUFFLES, "r11")


@query(
    "c10_control_windows",
    _D + """, c AS (SELECT doc_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM d WHERE length(s) >= 6),
w AS (SELECT doc_id, i, string_agg(c, '') OVER six AS word, count(*) FILTER (WHERE c IN ('G', 'C')) OVER six AS gc, count(*) FILTER (WHERE c <> 'N') OVER six AS letters FROM c WINDOW six AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
n AS (SELECT *, count(*) FILTER (WHERE word = 'CACGTG') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS near FROM w)
SELECT doc_id, i AS start1 FROM n WHERE letters = 6 AND gc = 4 AND near = 0""",
)
def _(spark, d):
    return seq.control_windows(dna(spark, d), "doc_id", "s", "CACGTG", 10)


@query("c11_spaced_controls")
def _(spark, d):
    w = seq.control_windows(dna(spark, d), "doc_id", "s", "CACGTG", 10).groupBy("doc_id").agg(F.collect_list("start1").alias("starts"))
    return w.select("doc_id", seq.spaced_choice(F.col("starts"), 6, F.concat(F.lit("c11|"), F.col("doc_id").cast("string")), 10).alias("chosen"))


@query("c18_coordinates", _D + " SELECT doc_id, length(s) AS n, regexp_matches(s, '^[ACGT]') AS begins, sha256(substr(s, 11, 90)) AS part, length(s) - length(replace(s, 'N', '')) AS missing FROM d WHERE length(s) >= 100")
def _(spark, d):
    s = F.col("s")
    return dna(spark, d).where(F.length(s) >= 100).select("doc_id", F.length(s).cast("long").alias("n"), s.rlike("^[ACGT]").alias("begins"), F.sha2(F.substring(s, 11, 90), 256).alias("part"), seq.count_of(s, "N").cast("long").alias("missing"))


@query("g9_gene_order", "WITH g AS (SELECT p_brand AS chrom, p_type AS gene, arg_max(p_partkey, (p_size, -p_partkey)) AS start FROM part GROUP BY ALL) SELECT chrom, gene, start, row_number() OVER (PARTITION BY chrom ORDER BY start, gene) - 1 AS place FROM g")
def _(spark, d):
    g = table(spark, d, "part").select(F.col("p_brand").alias("chrom"), F.col("p_type").alias("gene"), "p_size", F.col("p_partkey").alias("start"))
    one = ordered.best_row(g, ["chrom", "gene"], F.struct("p_size", -F.col("start")), "start")
    return ordered.row_numbers(one, ["chrom"], ["start", "gene"], "place").withColumn("place", F.col("place") - 1)


@query("g7_patristic", "WITH l AS (SELECT s_suppkey AS node, 1000 + s_nationkey AS up, 1.0 + s_suppkey % 5 AS w FROM supplier), r AS (SELECT 1000 + n_nationkey AS node, 2000 + n_regionkey AS up, 2.0 + n_nationkey % 3 AS w FROM nation), q AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey = b.s_nationkey AS same, na.n_regionkey = nb.n_regionkey AS near FROM supplier a JOIN nation na ON a.s_nationkey = na.n_nationkey JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation nb ON b.s_nationkey = nb.n_nationkey) SELECT q.a, q.b, CASE WHEN same THEN x.w + y.w ELSE x.w + y.w + u.w + v.w END AS distance FROM q JOIN l x ON x.node = a JOIN l y ON y.node = b JOIN r u ON u.node = x.up JOIN r v ON v.node = y.up WHERE same OR near")
def _(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    level = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("key"))  # noqa: E731  # keys of suppliers may be those of nations
    leaf = s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("up"), (1.0 + F.col("s_suppkey") % 5).alias("w"))
    mid = n.select(F.col("n_nationkey").alias("up"), F.col("n_regionkey").alias("top"), (2.0 + F.col("n_nationkey") % 3).alias("v"))
    two = leaf.join(mid, "up")
    lengths = leaf.select("node", level("supplier", "node").alias("ancestor"), F.lit(0).alias("depth"), F.lit(0.0).alias("length")).union(two.select("node", level("nation", "up"), F.lit(1), "w")).union(two.select("node", level("region", "top"), F.lit(2), F.col("w") + F.col("v")))
    pairs = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return graph.patristic(lengths, pairs).select("a", "b", "distance")


@query(
    "r15_permutation_jackknife",
    f"""WITH s AS (SELECT s_suppkey AS id, s_nationkey % 5 AS block, s_acctbal AS x, (s_suppkey % 3 = 0)::INT AS y FROM supplier), l AS (SELECT DISTINCT block AS left_out FROM s), t AS (SELECT left_out, id, x, y FROM l JOIN s ON block <> left_out),
a AS (SELECT left_out, y, row_number() OVER (PARTITION BY left_out ORDER BY id) AS i FROM t), b AS (SELECT left_out, x, rep, row_number() OVER (PARTITION BY left_out, rep ORDER BY sha256('r15|' || rep || '|' || id), id) AS i FROM t, range(1, 1001) u(rep)),
n AS (SELECT left_out, rep, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS t FROM b JOIN a USING (left_out, i) GROUP BY ALL), o AS (SELECT left_out, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS observed FROM t GROUP BY 1)
SELECT left_out, round(max(observed), 6) + 0.0 AS observed, round((1 + count(*) FILTER (WHERE round(t, 9) >= round(observed, 9))) / (1 + count(t)), 8) + 0.0 AS p FROM n JOIN o USING (left_out) GROUP BY 1""",
)
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("block"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 3 == 0).cast("int").alias("y"))
    return resampling.permutation_jackknife(s, "block", [], "id", "y", "x", 1000, "r15").select("left_out", F.round("observed", 6).alias("observed"), F.round("p", 8).alias("p"))


_CAT = "WITH s AS (SELECT p_partkey AS id, p_brand AS g, CASE p_size % 4 WHEN 0 THEN 'positive_up' WHEN 1 THEN 'positive_down' ELSE 'negative' END AS c, p_retailprice AS x FROM part WHERE p_size % 7 <> 0)"


def _categories(spark, d):
    k = F.col("p_size") % 4
    return table(spark, d, "part").where("p_size % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.when(k == 0, "positive_up").when(k == 1, "positive_down").otherwise("negative").alias("c"), F.col("p_retailprice").alias("x"))


@query("t14_oriented_response", _CAT + ", m AS (SELECT (count(*) FILTER (WHERE c = 'positive_up') - count(*) FILTER (WHERE c = 'positive_down')) / count(*) FILTER (WHERE c <> 'negative') AS m FROM s) SELECT id, round(x * CASE c WHEN 'positive_up' THEN 1 WHEN 'positive_down' THEN -1 ELSE m END, 6) + 0.0 AS oriented FROM s, m")
def _(spark, d):
    return statistics.oriented_response(_categories(spark, d), "c", "x").select("id", F.round("oriented", 6).alias("oriented"))


@query("t14_oriented_difference", _CAT + ", m AS (SELECT g, count(*) FILTER (WHERE c = 'positive_up') AS u, count(*) FILTER (WHERE c = 'positive_down') AS v, coalesce(sum(x) FILTER (WHERE c = 'positive_up'), 0) AS su, coalesce(sum(x) FILTER (WHERE c = 'positive_down'), 0) AS sv, avg(x) FILTER (WHERE c = 'negative') AS n FROM s GROUP BY g) SELECT g, round((su - sv) / nullif(u + v, 0) - (u - v) / nullif(u + v, 0) * n, 6) + 0.0 AS statistic FROM m")
def _(spark, d):
    return statistics.oriented_difference(_categories(spark, d), ["g"], "c", "x").select("g", F.round("statistic", 6).alias("statistic"))


@query(
    "v5_nearest_arm",
    """WITH e AS (SELECT vec_id, label % 4 AS arm, embedding, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS k FROM embeddings), p AS (SELECT a.vec_id, a.arm AS label, a.embedding AS x, b.embedding AS y FROM e a JOIN e b ON a.k = b.k AND b.arm = 3 WHERE a.arm < 3)"""
    + _CKA.replace("SELECT label::BIGINT AS label, round(sum(ab * ab) / sqrt(sum(aa * aa) * sum(bb * bb)), 6) + 0.0 AS cka FROM m GROUP BY label", ", c2 AS (SELECT label AS arm, sum(ab * ab) / sqrt(sum(aa * aa) * sum(bb * bb)) AS cka FROM m GROUP BY label)")
    + """, x AS (SELECT label AS arm, 1 - list_dot_product(x::DOUBLE[], y::DOUBLE[]) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[]) * list_dot_product(y::DOUBLE[], y::DOUBLE[])) AS d FROM p), z AS (SELECT arm, quantile_cont(d, 0.5) AS m FROM x GROUP BY 1)
SELECT (SELECT arg_min(arm, (-cka, arm)) FROM c2)::BIGINT AS by_cka, (SELECT arg_min(arm, (m, arm)) FROM z)::BIGINT AS by_cosine, (SELECT arg_min(arm, (-cka, arm)) FROM c2) = (SELECT arg_min(arm, (m, arm)) FROM z) AS concordant, (SELECT round(max(cka), 6) + 0.0 FROM c2) AS cka""",
)
def _(spark, d):
    """Arms 0 to 2 against arm 3, their vectors paired in order."""
    e = ordered.row_numbers(table(spark, d, "embeddings").select("vec_id", (F.col("label") % 4).cast("long").alias("arm"), "embedding"), ["arm"], ["vec_id"], "k")
    other = e.where("arm = 3").select("k", F.col("embedding").alias("y"))
    pairs = e.where("arm < 3").join(other, "k").select("arm", F.col("embedding").alias("x"), "y")
    distances = pairs.select("arm", vectors.cosine_distance(F.col("x"), F.col("y")).alias("distance"))
    cka = checkpoint(vectors.linear_cka(pairs, "x", "y", ["arm"]))
    return vectors.nearest_arm(cka, distances, "arm").crossJoin(cka.agg(F.round(F.max("cka"), 6).alias("cka")))
