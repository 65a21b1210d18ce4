"""Queries over vectors, hierarchies, neighbourhoods, matching and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators import assignment, graph, integrity, relational, trees, vectors
from weft.plans.registry import query, table


def _r(c, n=8):
    return F.round(c, n).alias(c)


_PAIR = "WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), p AS (SELECT a.vec_id, a.label, a.embedding AS x, b.embedding AS y FROM e a JOIN e b ON a.k = b.k AND b.label = (a.label + 1) % 10)"


def _pairs(spark, d):
    from weft.operators.ordered import row_numbers

    e = row_numbers(table(spark, d, "embeddings"), ["label"], ["vec_id"], "k")
    b = e.select(F.pmod(F.col("label") - 1, F.lit(10)).alias("label"), "k", F.col("embedding").alias("y"))
    return e.join(b, ["label", "k"]).select("vec_id", "label", F.col("embedding").alias("x"), "y")


@query("v1_cosine_displacement", _PAIR + " SELECT vec_id, round(1 - list_dot_product(x::DOUBLE[], y::DOUBLE[]) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[]) * list_dot_product(y::DOUBLE[], y::DOUBLE[])), 6) + 0.0 AS cosine, round(list_distance(x::DOUBLE[], y::DOUBLE[]) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])), 6) + 0.0 AS displacement FROM p")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, d).select("vec_id", F.round(vectors.cosine_distance(x, y), 6).alias("cosine"), F.round(vectors.relative_displacement(x, y), 6).alias("displacement"))


_CKA = """, q AS (SELECT vec_id, label, unnest(x)::DOUBLE AS a, unnest(y)::DOUBLE AS b, generate_subscripts(x, 1) AS i FROM p),
c AS (SELECT vec_id, label, i, a - avg(a) OVER (PARTITION BY label, i) AS a, b - avg(b) OVER (PARTITION BY label, i) AS b FROM q),
m AS (SELECT s.label, s.i, t.i AS j, sum(s.a * t.b) AS ab, sum(s.a * t.a) AS aa, sum(s.b * t.b) AS bb FROM c s JOIN c t USING (label, vec_id) GROUP BY ALL)
SELECT label::BIGINT AS label, round(sum(ab * ab) / sqrt(sum(aa * aa) * sum(bb * bb)), 6) + 0.0 AS cka FROM m GROUP BY label"""


@query("v2_linear_cka", _PAIR + _CKA)
def _(spark, d):
    return vectors.linear_cka(_pairs(spark, d).withColumn("label", F.col("label").cast("long")), "x", "y", ["label"]).select("label", _r("cka", 6))


@query("v3_procrustes")
def _(spark, d):
    return spark.createDataFrame([(round(vectors.procrustes_residual(_pairs(spark, d), "x", "y"), 8),)], "residual double")


@query("v4_explained_variance")
def _(spark, d):
    _, shares = vectors.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return spark.createDataFrame([(i + 1, round(s, 8)) for i, s in enumerate(shares)], "component long, share double")


@query("v6_both_strands", "SELECT vec_id, list_transform(range(1, 33), lambda i: round((embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE) / 2, 6) + 0.0) AS pooled FROM embeddings")
def _(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.transform(vectors.both_strands(e, 64), lambda x: F.round(x, 6) + 0.0).alias("pooled"))


@query("v7_concatenated", _PAIR + " SELECT vec_id, list_concat(x, y) AS whole FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.concat("x", "y").alias("whole"))


@query("v10_attribution", "WITH v AS (SELECT l_orderkey AS g, CASE WHEN l_linenumber = 1 THEN 'disruption' ELSE 'control' END AS kind, l_extendedprice AS x FROM lineitem) SELECT g, round(max(x) FILTER (WHERE kind = 'disruption') - quantile_cont(x, 0.5) FILTER (WHERE kind = 'control'), 6) + 0.0 AS delta, round(stddev_samp(x) FILTER (WHERE kind = 'control'), 6) + 0.0 AS control_sd FROM v GROUP BY g HAVING count(*) FILTER (WHERE kind = 'disruption') = 1 AND count(*) FILTER (WHERE kind = 'control') = 3")
def _(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.when(F.col("l_linenumber") == 1, "disruption").otherwise("control").alias("kind"), F.col("l_extendedprice").alias("x"))
    return vectors.attribution(v, "g", "kind", "x", 3).select("g", _r("delta", 6), _r("control_sd", 6))


_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 >= (SELECT min(p_partkey) FROM part) AND p_partkey // 3 <> p_partkey), c AS (SELECT node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.node, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.node)"


def _closure(spark, d):
    p = table(spark, d, "part")
    first = p.agg(F.min("p_partkey")).first()[0]
    e = p.select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("parent")).where((F.col("parent") >= first) & (F.col("parent") != F.col("node")))
    return graph.ancestors(e)


@query("g1_ancestor_closure", _TREE + " SELECT node, ancestor, depth::BIGINT AS depth FROM c")
def _(spark, d):
    return _closure(spark, d).select("node", "ancestor", F.col("depth").cast("long").alias("depth"))


@query(
    "g2_tree_distance",
    _TREE + ", s AS (SELECT * FROM c UNION ALL SELECT p_partkey, p_partkey, 0 FROM part), q AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R') SELECT a, b, min(x.depth + y.depth)::BIGINT AS distance FROM q JOIN s x ON x.node = a JOIN s y ON y.node = b AND y.ancestor = x.ancestor GROUP BY a, b",
)
def _(spark, d):
    whole = graph.with_self(_closure(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")))
    q = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return graph.path_distance(q, whole).select("a", "b", F.col("distance").cast("long").alias("distance"))


_SETS = "WITH m AS (SELECT DISTINCT s_suppkey AS id, p_type || '|' || p_size AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size <= 10), n AS (SELECT id, count(*) AS n FROM m GROUP BY id)"


def _members(spark, d):
    p = table(spark, d, "part").where("p_size <= 10").select("p_partkey", F.concat_ws("|", "p_type", F.col("p_size").cast("string")).alias("item"))
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), "item").distinct()


@query("g3_shared_jaccard", _SETS + " SELECT a.id AS a, b.id AS b, round(count(*) / (max(x.n) + max(y.n) - count(*)), 8) + 0.0 AS jaccard FROM m a JOIN m b ON a.item = b.item AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY a.id, b.id")
def _(spark, d):
    return graph.shared_jaccard(_members(spark, d), "id", "item").select("a", "b", _r("jaccard"))


@query("g3_spanning_edges")
def _(spark, d):
    return graph.jaccard_spanning_edges(_members(spark, d), "id", "item", 0.95).select("a", "b", _r("jaccard"))


#: Trees of 60 customers, three for each block: customers by a product modulo 12, those by what is left modulo 4; a seventh of the customers is missing.
_TREES = """WITH l AS (SELECT c_custkey // 60 * 3 + k AS tree, c_custkey // 60 AS blk, c_custkey AS c, c_custkey * (k + 3) % 12 AS g, c_custkey * (k + 3) % 12 % 4 AS h FROM customer, range(0, 3) t(k) WHERE c_custkey % 7 <> k)"""


def _trees(spark, d):
    from weft.sources import readers

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("c % 7 <> k")
    leaf = c.select((F.floor(F.col("c") / 60) * 3 + F.col("k")).alias("tree"), "c", (F.col("c") * (F.col("k") + 3) % 12).alias("g"))
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x.t), ",")
    inner = leaf.groupBy("tree", "g").agg(F.concat(F.lit("("), joined("c", F.concat(F.lit("c"), F.col("c").cast("string"), F.lit(":1.5"))), F.lit(")g"), F.col("g").cast("string"), F.lit(":1")).alias("t")).withColumn("h", F.col("g") % 4)
    outer = inner.groupBy("tree", "h").agg(F.concat(F.lit("("), joined("g", F.col("t")), F.lit(")h"), F.col("h").cast("string"), F.lit(":0.5")).alias("t"))
    whole = outer.groupBy("tree").agg(F.concat(F.lit("("), joined("h", F.col("t")), F.lit(")root;")).alias("newick"))
    return readers.newick_edges(whole, "tree", "newick")


@query(
    "g5_layout",
    _TREES + """, y AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY h, g, c) - 1 AS y FROM l), i AS (SELECT tree, h, g, avg(y) AS y FROM y GROUP BY ALL), o AS (SELECT tree, h, avg(y) AS y FROM i GROUP BY ALL)
SELECT tree, 'c' || c AS label, 3.0::DOUBLE AS x, round(y, 6) + 0.0 AS y FROM y UNION ALL SELECT tree, 'g' || g, 1.5, round(y, 6) FROM i UNION ALL SELECT tree, 'h' || h, 0.5, round(y, 6) FROM o UNION ALL SELECT tree, 'root', 0.0, round(avg(y), 6) FROM o GROUP BY tree""",
)
def _(spark, d):
    e = _trees(spark, d)
    return trees.layout(e, "tree").join(e.select("tree", "node", "label"), ["tree", "node"]).select("tree", "label", _r("x", 6), _r("y", 6))


@query(
    "g6_robinson_foulds",
    _TREES + """, p AS (SELECT DISTINCT x.tree AS a, y.tree AS b FROM l x JOIN l y ON x.blk = y.blk AND x.tree < y.tree), n AS (SELECT a, b, x.c FROM p JOIN l x ON x.tree = a JOIN l y ON y.tree = b AND y.c = x.c),
w AS (SELECT a, b, count(*) AS common, min('c' || c) AS first, list(c) AS every FROM n GROUP BY ALL), s AS (SELECT a, b, unnest([a, b]) AS tree FROM p),
v AS (SELECT s.*, l.c, unnest(['g' || g, 'h' || h]) AS clade FROM s JOIN l USING (tree) JOIN n ON n.a = s.a AND n.b = s.b AND n.c = l.c),
q AS (SELECT a, b, tree, clade, list(c) AS side FROM v GROUP BY ALL), k AS (SELECT DISTINCT a, b, tree, list_sort(CASE WHEN list_contains(list_transform(side, lambda x: 'c' || x), first) THEN list_filter(every, lambda x: NOT list_contains(side, x)) ELSE side END) AS split FROM q JOIN w USING (a, b) WHERE len(side) BETWEEN 2 AND common - 2),
r AS (SELECT a, b, count(*) AS differing FROM (SELECT a, b, split FROM k GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL)
SELECT p.a, p.b, coalesce(common, 0) AS common, CASE WHEN common >= 4 THEN coalesce(differing, 0) END AS differing, CASE WHEN common >= 4 THEN round(coalesce(differing, 0) / (2 * (common - 3)), 8) + 0.0 END AS distance FROM p LEFT JOIN w USING (a, b) LEFT JOIN r USING (a, b)""",
)
def _(spark, d):
    e = _trees(spark, d)
    own = e.select("tree").distinct().withColumn("blk", F.floor(F.col("tree") / 3))
    pairs = own.select(F.col("tree").alias("a"), "blk").join(own.select(F.col("tree").alias("b"), "blk"), "blk").where("a < b")  # three trees a block
    return trees.split_distances(e, pairs, "tree").select("a", "b", "common", "differing", _r("distance"))


@query("g8_synteny")
def _(spark, d):
    """Families are types and sizes of parts, the two genomes brands 1 to 10 against the others, neighbours in the order of a brand."""
    name = F.concat_ws("|", "p_type", F.col("p_size").cast("string"))
    side = F.when(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") <= 10, "left").otherwise("right")
    p = table(spark, d, "part").select("p_brand", side.alias("side"), F.struct("p_partkey", name.alias("family")).alias("at"))
    w = graph.neighbour_window(p, ["p_brand"], "at", 5)
    others = F.transform(F.filter("window", lambda x: x.p_partkey != F.col("at.p_partkey")), lambda x: x.family)
    genes = w.select(F.col("at.p_partkey").alias("id"), F.col("at.family").alias("family"), "side", others.alias("window"))
    return assignment.family_synteny(genes, ["family"]).select("family", "n_left", "n_right", _r("jaccard"))


@query("j17_greedy_match")
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("target_id"), F.col("s_acctbal").alias("x"))
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("control_id"), F.col("c_acctbal").alias("x"))
    return assignment.greedy_pairs(t, p, ["k"], "x").select("k", "target_id", "control_id", _r("distance", 6))


@query("m3_row_fingerprint", "SELECT count(*) AS n, bit_xor(('0x' || substr(sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_orderstatus, coalesce(o_orderpriority, chr(0)))), 1, 15))::BIGINT) AS fingerprint FROM orders")
def _(spark, d):
    return integrity.row_fingerprint(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("i1_named_checks", "SELECT 'unique' AS name, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders UNION ALL SELECT 'priced', bool_and(o_totalprice > 0) FROM orders UNION ALL SELECT 'all_open', bool_and(o_orderstatus = 'O') FROM orders")
def _(spark, d):
    return integrity.checks(table(spark, d, "orders"), unique=F.count(F.lit(1)) == F.count_distinct("o_orderkey"), priced=F.bool_and(F.col("o_totalprice") > 0), all_open=F.bool_and(F.col("o_orderstatus") == "O"))


@query("i3_frame_mismatches", "WITH a AS (SELECT event_id, value, event_type FROM events WHERE event_id % 7 <> 0), b AS (SELECT event_id, value + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 1e-13 END AS value, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE event_type END AS event_type FROM events WHERE event_id % 13 <> 0) SELECT event_id, unnest(CASE WHEN a.event_id IS NULL OR b.event_id IS NULL THEN ['<row>'] ELSE list_concat(CASE WHEN abs(a.value - b.value) > 1e-9 + 1e-9 * abs(b.value) THEN ['value'] ELSE [] END, CASE WHEN a.event_type <> b.event_type THEN ['event_type'] ELSE [] END) END) AS column FROM a FULL JOIN b USING (event_id)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    k = F.col("event_id")
    b = e.where(k % 13 != 0).select("event_id", (F.col("value") + F.when(k % 5 == 0, 1.0).otherwise(1e-13)).alias("value"), F.when(k % 11 == 0, "x").otherwise(F.col("event_type")).alias("event_type"))
    return integrity.frame_mismatches(e.where(k % 7 != 0), b, ["event_id"], ["value"], ["event_type"])


@query("i4_pair_integrity", "SELECT doc_id // 2 AS pair, count(*) AS n, count(DISTINCT quality) AS labels FROM labels GROUP BY 1 HAVING count(*) <> 2 OR count(DISTINCT quality) <> 2")
def _(spark, d):
    x = table(spark, d, "labels").withColumn("pair", F.floor(F.col("doc_id") / 2))
    return integrity.pair_integrity(x, "pair", "quality")


@query("m9_jitter", "SELECT p_partkey, round((('0x' || substr(sha256(p_name), 1, 8))::BIGINT / 4294967295.0 * 2 - 1) * 0.3, 8) + 0.0 AS jitter FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(hashing.jitter(0.3, F.col("p_name")), 8).alias("jitter"))


@query("t22_balanced_weights", "SELECT doc_id, round(0.25 / count(*) OVER (PARTITION BY lang, quality), 10) + 0.0 AS weight FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    from weft.operators.statistics import balanced_weights

    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return balanced_weights(x, ["lang", "quality"], 0.25).select("doc_id", _r("weight", 10))


@query("j6_match_required", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return relational.checked_join(table(spark, d, "orders"), c, ["o_custkey"], "left", require_match=True).select("o_orderkey", "c_name")
