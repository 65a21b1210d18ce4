"""The smaller operators of the inventory, one query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import hashing, scalars
from weft.operators import metrics, ordered, probes, relational, statistics
from weft.plans.registry import query, table


def _r(c, n=8):
    return F.round(c, n).alias(c)


@query("p1_projection", "SELECT p_partkey AS part, p_name AS name, p_retailprice * 2 AS doubled FROM part")
def _(spark, d):
    return table(spark, d, "part").drop("p_size").withColumnRenamed("p_partkey", "part").select("part", F.col("p_name").alias("name"), (F.col("p_retailprice") * 2).alias("doubled"))


@query("p5_string_predicate", "SELECT doc_id, source FROM documents WHERE lang = 'de' AND n_chars > 3000")
def _(spark, d):
    return table(spark, d, "documents").filter("lang = 'de' AND n_chars > 3000").select("doc_id", "source")


@query("p10_coalesce_without_conflict", "WITH x AS (SELECT event_id, json_extract_string(props, '$.k') AS a, CASE WHEN event_id % 3 = 0 THEN event_type END AS b FROM events) SELECT event_id, coalesce(a, b) AS id FROM x WHERE NOT (a IS NOT NULL AND b IS NOT NULL AND a <> b)")
def _(spark, d):
    x = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("b"))
    return x.where(~(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.coalesce("a", F.lit("")) != F.coalesce("b", F.lit(""))))).select("event_id", F.coalesce("a", "b").alias("id"))


@query("p11_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS state, o_orderstatus NOT IN ('F', 'O') AS unmapped FROM orders")
def _(spark, d):
    names = spark.createDataFrame([("F", "finished"), ("O", "open")], "o_orderstatus string, state string")
    return table(spark, d, "orders").join(F.broadcast(names), "o_orderstatus", "left").select("o_orderkey", "state", F.col("state").isNull().alias("unmapped"))


@query("p16_transfer_populations", "WITH t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem WHERE l_returnflag <> 'R') SELECT population, count(*) AS n FROM (SELECT unnest(['all', CASE WHEN l_linestatus = 'O' THEN 'heldout' END, CASE WHEN l_partkey NOT IN (SELECT l_partkey FROM t) THEN 'novel' END]) AS population FROM x) WHERE population IS NOT NULL GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem")
    seen = li.where("l_returnflag = 'R'").select("l_partkey").distinct().withColumn("seen", F.lit(True))
    x = li.where("l_returnflag <> 'R'").join(seen, "l_partkey", "left")
    masks = F.array_compact(F.array(F.lit("all"), F.when(F.col("l_linestatus") == "O", "heldout"), F.when(F.col("seen").isNull(), "novel")))
    return x.select(F.explode(masks).alias("population")).groupBy("population").agg(F.count(F.lit(1)).alias("n"))


@query("p17_life_form", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'tree') OR contains(lower(p_type), 'steel') THEN 'tree' WHEN contains(lower(p_type), 'brass') THEN 'shrub' ELSE 'herb' END AS form, nullif(lower(trim(p_brand)), '') AS direction FROM part")
def _(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    form = scalars.first_match("herb", tree=scalars.contains_any(name, ["tree"]) | scalars.contains_any(kind, ["steel"]), shrub=scalars.contains_any(kind, ["brass"]))
    return table(spark, d, "part").select("p_partkey", form.alias("form"), F.nullif(F.lower(F.trim("p_brand")), F.lit("")).alias("direction"))


@query("p18_support_label", "SELECT c_nationkey, CASE WHEN a > 0 AND b > 0 AND c > 0 THEN 'all' WHEN a > 0 AND b > 0 THEN 'anchor_first' WHEN a > 0 AND c > 0 THEN 'anchor_second' WHEN a > 0 THEN 'anchor_only' ELSE 'none' END AS support FROM (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 9900) AS a, count(*) FILTER (WHERE c_acctbal < -950) AS b, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE' AND c_acctbal < 0) AS c FROM customer GROUP BY 1)")
def _(spark, d):
    b = F.col("c_acctbal")
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(b > 9900).alias("a"), F.count_if(b < -950).alias("b"), F.count_if((F.col("c_mktsegment") == "FURNITURE") & (b < 0)).alias("c"))
    x, y, z = (F.col(k) > 0 for k in "abc")
    return g.select("c_nationkey", scalars.first_match("none", all=x & y & z, anchor_first=x & y, anchor_second=x & z, anchor_only=x).alias("support"))


@query("j3_left_join", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return relational.checked_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "left").na.fill({"quality": -1})


@query("j11_suffix_pair", "SELECT a.c_custkey, round(a.m - b.m, 6) + 0.0 AS gap FROM (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a JOIN (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b USING (c_custkey)")
def _(spark, d):
    side = lambda p, s: table(spark, d, "orders").where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m" + s))
    both = relational.checked_join(side("1-URGENT", "_tree"), side("5-LOW", "_control"), ["c_custkey"], validate="one_to_one")
    return both.select("c_custkey", F.round(F.col("m_tree") - F.col("m_control"), 6).alias("gap"))


@query(
    "j16_nearest_controls",
    """WITH t AS (SELECT s_suppkey AS target_id, s_nationkey AS k, s_acctbal AS x FROM supplier WHERE s_acctbal > 8000), p AS (SELECT s_suppkey AS control_id, s_nationkey AS k, s_acctbal AS y FROM supplier WHERE s_acctbal <= 8000),
m AS (SELECT target_id, control_id, abs(x - y) AS d, CASE WHEN abs(x - y) <= 1000 THEN 1 WHEN abs(x - y) <= 3000 THEN 2 WHEN abs(x - y) <= 12000 THEN 3 END AS stage FROM t JOIN p USING (k) WHERE target_id <> control_id),
c AS (SELECT target_id, count(*) FILTER (WHERE stage <= 1) AS n1, count(*) FILTER (WHERE stage <= 2) AS n2, count(*) AS n3 FROM m GROUP BY 1),
u AS (SELECT target_id, CASE WHEN n1 >= 2 THEN 1 WHEN n2 >= 2 THEN 2 WHEN n3 >= 2 THEN 3 END AS stage FROM c)
SELECT target_id, control_id, u.stage FROM m JOIN u USING (target_id) WHERE m.stage <= u.stage QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY d, control_id) <= 3""",
)
def _(spark, d):
    s = table(spark, d, "supplier")
    t = s.where("s_acctbal > 8000").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"))
    p = s.where("s_acctbal <= 8000").select(F.col("s_suppkey").alias("control_id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("y"))
    return relational.staged_match(t, p, ["k"], "x", "y", [1000, 3000, 12000], 2, 3, F.col("control_id")).select("target_id", "control_id", "stage")


@query("j20_bridge_rates", "WITH x AS (SELECT o_orderkey, c_custkey, s_suppkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = c_custkey) SELECT count(*) AS n, round(avg((c_custkey IS NOT NULL)::INT), 8) + 0.0 AS first, round(avg((s_suppkey IS NOT NULL)::INT), 8) + 0.0 AS second FROM x")
def _(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("mid"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mid"), F.col("s_suppkey").alias("far"))
    x = relational.checked_join(relational.checked_join(table(spark, d, "orders"), c, ["o_custkey"], "left"), s, ["mid"], "left")
    rate = lambda k: F.round(F.avg(F.col(k).isNotNull().cast("int")), 8)
    return x.agg(F.count(F.lit(1)).alias("n"), rate("mid").alias("first"), rate("far").alias("second"))


@query("j22_fallback_match", "WITH a AS (SELECT p_partkey, p_name AS id FROM part), b AS (SELECT p_name AS id, p_size AS v FROM part WHERE p_size > 30), s AS (SELECT string_split(p_name, ' ')[1] AS stem, min(p_size) AS w, count(*) AS k FROM part WHERE p_size > 30 GROUP BY 1), b1 AS (SELECT id, min(v) AS v FROM b GROUP BY id) SELECT p_partkey, coalesce(b1.v, CASE WHEN s.k = 1 THEN s.w END) AS v, CASE WHEN b1.v IS NOT NULL THEN 'exact' WHEN s.k = 1 THEN 'stem' ELSE 'none' END AS how FROM a LEFT JOIN b1 USING (id) LEFT JOIN s ON s.stem = string_split(id, ' ')[1]")
def _(spark, d):
    p = table(spark, d, "part")
    stem = F.split("p_name", " ")[0]
    exact = p.where("p_size > 30").groupBy("p_name").agg(F.min("p_size").alias("v"))
    loose = p.where("p_size > 30").groupBy(stem.alias("stem")).agg(F.min("p_size").alias("w"), F.count(F.lit(1)).alias("k"))
    x = p.select("p_partkey", "p_name", stem.alias("stem")).join(exact, "p_name", "left").join(loose, "stem", "left")
    only = F.when(F.col("k") == 1, F.col("w"))
    return x.select("p_partkey", F.coalesce("v", only).alias("v"), scalars.first_match("none", exact=F.col("v").isNotNull(), stem=F.coalesce(F.col("k") == 1, F.lit(False))).alias("how"))


@query("a4_value_counts", "SELECT event_type AS value, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("a8_first_per_key", "SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1")
def _(spark, d):
    return ordered.least_row(table(spark, d, "lineitem"), ["l_partkey"], F.struct("l_shipdate", "l_orderkey", "l_linenumber"), "l_orderkey")


@query("a11_membership_matrix", "SELECT n_name, coalesce(max(1) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000), 0)::BIGINT AS building, coalesce(max(1) FILTER (WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000), 0)::BIGINT AS machinery FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").withColumn("one", F.lit(1).cast("long"))
    wide = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.max("one")).na.fill(0)
    return wide.select("n_name", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"))


@query("a19_feature_counts", "SELECT count(*) FILTER (WHERE event_type = 'click') AS genes, coalesce(nullif(count(DISTINCT user_id) FILTER (WHERE event_type = 'absent'), 0), count(DISTINCT user_id)) AS ids FROM events")
def _(spark, d):
    absent = F.count_distinct(F.when(F.col("event_type") == "absent", F.col("user_id")))
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "click").alias("genes"), F.coalesce(F.nullif(absent, F.lit(0)), F.count_distinct("user_id")).alias("ids"))


@query("a23_copy_numbers", "WITH c AS (SELECT r_name, p_brand, coalesce(n, 0) AS n FROM (SELECT r_name, r_regionkey FROM region) CROSS JOIN (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT p_brand AS b, p_partkey % 5 AS k, count(*) AS n FROM part WHERE p_size = 7 GROUP BY ALL) ON b = p_brand AND k = r_regionkey) SELECT p_brand, quantile_cont(n, 0.5) AS median, max(n) AS most, count(*) FILTER (WHERE n > 0) AS breadth FROM c GROUP BY 1")
def _(spark, d):
    p, r = table(spark, d, "part"), table(spark, d, "region")
    counts = p.where("p_size = 7").groupBy("p_brand", (F.col("p_partkey") % 5).cast("int").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    c = relational.zero_filled(r.select("r_regionkey"), p.select("p_brand").distinct(), counts, ["r_regionkey", "p_brand"], "n")
    return c.groupBy("p_brand").agg(F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") > 0).alias("breadth"))


@query("a27_percentages", "SELECT lang, round(100 * count(*) FILTER (WHERE toxic = 1) / count(*), 6) + 0.0 AS toxic_percent, round(100 * count(*) FILTER (WHERE quality = 0) / count(*), 6) + 0.0 AS poor_percent FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    share = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 6)
    return x.groupBy("lang").agg(share(F.col("toxic") == 1).alias("toxic_percent"), share(F.col("quality") == 0).alias("poor_percent"))


@query("w3_rank_across_arms", "WITH m AS (SELECT o_custkey, o_orderpriority AS arm, max(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_custkey, arm, rank() OVER (PARTITION BY o_custkey ORDER BY v DESC) + (count(*) OVER (PARTITION BY o_custkey, v) - 1) / 2 AS r FROM m")
def _(spark, d):
    m = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("arm")).agg((-F.max("o_totalprice")).alias("v"))
    return ordered.average_ranks(m, ["o_custkey"], "v", "r").select("o_custkey", "arm", "r")


@query("w6_running_total", "SELECT event_id, sum(event_id) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS total, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return ordered.running_sums(e, ["event_type"], ["event_id"], {"total": "event_id", "k": F.lit(1).cast("long")}).select("event_id", "total", (F.col("k") - 1).alias("place"))


@query("w9_ranked_table", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal, s_suppkey) AS rank FROM supplier")
def _(spark, d):
    return ordered.row_numbers(table(spark, d, "supplier"), [], [F.desc("s_nationkey"), "s_acctbal", "s_suppkey"], "rank").select("s_suppkey", "rank")


@query("w13_best_of_cells", "SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def _(spark, d):
    return ordered.best_row(table(spark, d, "customer"), ["c_mktsegment"], F.struct("c_acctbal", -F.col("c_custkey")), "c_custkey")


@query("u1_ragged_union", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("u4_set_gates", "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS subset, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS equal")
def _(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    empty = lambda a, b, n: a.join(b, "k", "left_anti").agg((F.count(F.lit(1)) == 0).alias(n))
    return empty(o, c, "subset").join(F.broadcast(empty(c, o, "equal")))


@query("u7_ordered_distinct", "SELECT conv_id, list_transform(list_filter(range(1, len(r) + 1), lambda i: list_position(r, r[i]) = i), lambda i: r[i]) AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1)")
def _(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_distinct(F.transform("t", lambda x: x.role)).alias("roles"))


@query("u8_reindex", "SELECT n_nationkey, m FROM nation LEFT JOIN (SELECT s_nationkey, round(avg(s_acctbal), 6) + 0.0 AS m FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def _(spark, d):
    m = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.avg("s_acctbal"), 6).alias("m"))
    return table(spark, d, "nation").select("n_nationkey").join(m, "n_nationkey", "left")


@query("m8_edge_bins", "SELECT event_type, least(floor(least(value, 200) / 200 * 15), 14)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    p = F.least(F.col("value"), F.lit(200.0)) / 200
    return table(spark, d, "events").groupBy("event_type", scalars.equal_width_bin(p, 15).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("m10_set_jaccard", "SELECT conv_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) + 0.0 AS jaccard FROM (SELECT conv_id, list_distinct(string_split(lower(min(text) FILTER (WHERE turn = 0)), ' ')) AS a, list_distinct(string_split(lower(min(text) FILTER (WHERE turn = 1)), ' ')) AS b FROM conversations GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    turn = lambda k: F.array_distinct(F.split(F.lower(F.min(F.when(F.col("turn") == k, F.col("text")))), " "))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return g.select("conv_id", F.round(scalars.jaccard(F.col("a"), F.col("b")), 8).alias("jaccard"))


@query("m16_gain_over_no_skill", "SELECT lang, round(avg(quality), 8) + 0.0 AS prevalence, round(1 - avg(quality), 8) + 0.0 AS absolute, round((1 - avg(quality)) / avg(quality), 8) + 0.0 AS relative FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("p"))
    return x.select("lang", F.round("p", 8).alias("prevalence"), F.round(1 - F.col("p"), 8).alias("absolute"), F.round(scalars.ratio(1 - F.col("p"), F.col("p")), 8).alias("relative"))


@query("t6_eligible_terms", "WITH t AS (SELECT p_type || '|' || p_size AS term, count(*) AS n FROM part GROUP BY 1), a AS (SELECT count(*) AS total FROM part) SELECT term, n FROM t, a WHERE n >= 5 AND n <= 0.8 * total AND total - n >= 5")
def _(spark, d):
    p = table(spark, d, "part")
    t = p.groupBy(F.concat_ws("|", "p_type", F.col("p_size").cast("string")).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return t.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("total")))).where("n >= 5 AND n <= 0.8 * total AND total - n >= 5").select("term", "n")


@query("t24_expression_rank_score", "WITH c AS (SELECT l_partkey AS g, l_returnflag AS study, sum(l_quantity) AS y FROM lineitem GROUP BY ALL), l AS (SELECT g, study, log2(y / sum(y) OVER (PARTITION BY study) * 1e6 + 0.5) AS v FROM c), r AS (SELECT g, study, (rank() OVER (PARTITION BY study ORDER BY round(v, 6)) + (count(*) OVER (PARTITION BY study, round(v, 6)) - 1) / 2) / count(*) OVER (PARTITION BY study) AS k FROM l) SELECT g, round(avg(k), 8) + 0.0 AS score FROM r GROUP BY g HAVING count(*) = 3")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("g"), F.col("l_returnflag").alias("study")).agg(F.sum("l_quantity").alias("y"))
    v = statistics.log_cpm(c, "study", "y").withColumn("v", F.round("log_cpm", 6))
    n = v.groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    k = ordered.average_ranks(v, ["study"], "v", "rank").join(n, "study")
    return k.groupBy("g").agg(F.round(F.avg(F.col("rank") / F.col("n")), 8).alias("score"), F.count(F.lit(1)).alias("s")).where("s = 3").select("g", "score")


@query("t18_detectable_effect", "SELECT lang, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(n_chars) / sqrt(count(*)), 6) + 0.0 AS mde FROM documents GROUP BY lang")
def _(spark, d):
    z = statistics.minimum_detectable_effect(1.0, 1)
    return table(spark, d, "documents").groupBy("lang").agg(F.round(z * F.stddev_samp("n_chars") / F.sqrt(F.count(F.lit(1))), 6).alias("mde"))


@query("d6_sample_design", "SELECT o_orderkey, arm, o_orderstatus FROM orders JOIN (VALUES ('F', '1-URGENT', 'baseline'), ('O', '1-URGENT', 'endpoint')) v(s, p, arm) ON s = o_orderstatus AND p = o_orderpriority")
def _(spark, d):
    design = spark.createDataFrame([("F", "1-URGENT", "baseline"), ("O", "1-URGENT", "endpoint")], "o_orderstatus string, o_orderpriority string, arm string")
    return table(spark, d, "orders").join(F.broadcast(design), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "arm", "o_orderstatus")


@query("d7_tiered_catalog", "WITH e AS (SELECT p_partkey, (p_size > 25)::INT + (p_retailprice > 1200)::INT + (p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 25))::INT AS k FROM part) SELECT p_partkey, k::BIGINT AS evidence, ['D', 'C', 'B', 'A'][k + 1] AS tier, row_number() OVER (ORDER BY k DESC, p_partkey) AS place FROM e")
def _(spark, d):
    p = table(spark, d, "part")
    large = p.groupBy("p_brand").agg((F.avg("p_size") > 25).alias("large"))
    k = (F.col("p_size") > 25).cast("long") + (F.col("p_retailprice") > 1200).cast("long") + F.col("large").cast("long")
    e = relational.checked_join(p, large, ["p_brand"]).select("p_partkey", k.alias("evidence"))
    return ordered.row_numbers(e, [], [F.desc("evidence"), "p_partkey"], "place").select("p_partkey", "evidence", F.element_at(F.array(*map(F.lit, "DCBA")), F.col("evidence").cast("int") + 1).alias("tier"), "place")


@query("d8_evidence_matrix", "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(k, 0) AS turns, CASE WHEN quality = 1 AND k > 3 THEN 'both' WHEN quality = 1 THEN 'label' WHEN k > 3 THEN 'talk' ELSE 'none' END AS evidence FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1) ON conv_id = d.doc_id")
def _(spark, d):
    k = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"))
    x = relational.checked_join(relational.checked_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], "left"), k, ["doc_id"], "left")
    q, t = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("turns") > 3, F.lit(False))
    return x.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("turns", F.lit(0).cast("long")).alias("turns"), scalars.first_match("none", both=q & t, label=q, talk=t).alias("evidence"))


@query("i10_quality_thresholds", "SELECT s_suppkey, concat_ws(';', CASE WHEN n < 550 THEN 'few' END, CASE WHEN late > 0.35 THEN 'late' END) AS violations FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n, avg((l_tax > 0.05)::INT) AS late FROM lineitem GROUP BY 1)")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_tax") > 0.05).cast("int")).alias("late"))
    return g.select("s_suppkey", scalars.reasons(few=F.col("n") < 550, late=F.col("late") > 0.35).alias("violations"))


@query("t20_linear_probe")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("double"))
    half = hashing.bucket(2, F.lit("probe"), F.col("vec_id").cast("string"))
    scored = probes.linear_probe(e.where(half == 0), "embedding", "y")(e.where(half == 1))
    return metrics.average_precision(scored, [], "probability", "y").select(_r("auprc", 4))


@query("t21_t23_tree_probe_leave_one_out")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("double")).withColumn("genus", F.when(F.col("label") < 5, "first").otherwise("second"))
    scored = probes.leave_one_group_out(e, "genus", ["first", "second"], lambda train: probes.tree_probe(train, "embedding", "y", 5, 3))
    return scored.groupBy("genus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 4).alias("mean_probability"))


@query("c16_prefix_classes", "SELECT p_partkey, regexp_replace(p_type, '^(PROMO|ECONOMY) ', '') AS bare, CASE WHEN starts_with(p_type, 'PROMO') THEN 'promo' WHEN starts_with(p_type, 'ECONOMY') THEN 'economy' ELSE 'other' END AS class FROM part")
def _(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(t, "^(PROMO|ECONOMY) ", "").alias("bare"), scalars.first_match("other", promo=t.startswith("PROMO"), economy=t.startswith("ECONOMY")).alias("class"))


@query("d4_consolidation", "SELECT lang, count(*) AS n, count(DISTINCT coalesce(text, '')) AS different, sum(length(coalesce(text, '')))::BIGINT AS letters, count(*) FILTER (WHERE ('0x' || substr(sha256('split|' || doc_id), 1, 8))::BIGINT % 100 = 0) AS validation FROM documents GROUP BY lang")
def _(spark, d):
    # different texts by digest, so no text is shuffled
    t = F.coalesce("text", F.lit(""))
    x = table(spark, d, "documents").select("lang", F.sha2(t, 256).alias("h"), F.length(t).alias("k"), (hashing.bucket(100, F.lit("split"), F.col("doc_id").cast("string")) == 0).alias("v"))
    g = x.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.count_if("v").alias("v"))
    return g.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"), F.sum("k").alias("letters"), F.sum("v").alias("validation"))


@query("t11_size_factors", "WITH c AS (SELECT l_suppkey % 4 AS s, l_partkey * 4 + l_linenumber % 4 AS g, sum(l_quantity) AS y FROM lineitem GROUP BY ALL), f AS (SELECT g, avg(ln(y)) AS m FROM c WHERE y > 0 GROUP BY g HAVING count(*) = (SELECT count(DISTINCT s) FROM c)) SELECT s, round(exp(quantile_cont(ln(y) - m, 0.5)), 6) + 0.0 AS factor FROM c JOIN f USING (g) WHERE y > 0 GROUP BY s")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("s"), (F.col("l_partkey") * 4 + F.col("l_linenumber") % 4).alias("g")).agg(F.sum("l_quantity").alias("y"))
    return statistics.size_factors(c, "s", "g", "y").select("s", _r("factor", 6))
