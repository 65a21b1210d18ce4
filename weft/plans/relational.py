"""Queries over scans, projections, joins, aggregations, orders and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import hashing, scalars
from weft.operators import ordered, relational
from weft.plans.registry import query, table

ARMS = {"tree": "1-URGENT", "herb": "2-HIGH", "random_arm": "3-MEDIUM", "matched_arm": "4-NOT SPECIFIED", "base": "5-LOW"}
CONTROLS = ["herb", "random_arm", "matched_arm"]
_ARM_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in ARMS.items()) + " END"


def arm(c="o_orderpriority"):
    return F.create_map(*[F.lit(x) for k, v in ARMS.items() for x in (v, k)])[F.col(c)]


@query("s2_pruned_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey", "o_orderpriority")


@query("p4_between_coalesce", "SELECT p_partkey, coalesce(p_brand, '') AS brand, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#12', 'Brand#23') OR p_size = 1")
def _(spark, d):
    keep = (F.col("p_size").between(5, 30) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#12", "Brand#23")) | (F.col("p_size") == 1)
    return table(spark, d, "part").where(keep).select("p_partkey", F.coalesce("p_brand", F.lit("")).alias("brand"), "p_size")


@query("p6_regex_rows", "SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)$', 2) AS num FROM customer WHERE regexp_matches(c_name, '^[A-Za-z]+#[0-9]+$')")
def _(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").rlike("^[A-Za-z]+#[0-9]+$")).select("c_custkey", F.regexp_extract("c_name", "^([A-Za-z]+)#0*([0-9]+)$", 2).alias("num"))


@query("p7_coercion", "SELECT event_id, try_cast(json_extract_string(props, '$.' || 'k') AS DOUBLE) AS k, coalesce(lower(trim(event_type)) IN ('true', '1', 'yes', 'click'), false) AS flag FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalars.as_number(F.get_json_object("props", "$.k")).alias("k"), (scalars.as_boolean(F.col("event_type")) | (F.lower(F.trim("event_type")) == "click")).alias("flag"))


@query(
    "p13_exclusion_reasons",
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END, CASE WHEN c_nationkey % 5 = 0 THEN 'nation' END) AS reasons,
CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 3000 THEN 'low' ELSE 'high' END AS class, CASE WHEN c_nationkey >= 3 THEN '3+' ELSE CAST(CAST(c_nationkey AS BIGINT) AS VARCHAR) END AS stratum FROM customer""",
)
def _(spark, d):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    why = scalars.reasons(negative_balance=b < 0, segment=F.col("c_mktsegment") == "MACHINERY", nation=n % 5 == 0)
    return table(spark, d, "customer").select("c_custkey", why.alias("reasons"), scalars.first_match("high", debt=b < 0, low=b < 3000).alias("class"), scalars.capped_count(n, 3).alias("stratum"))


@query(
    "p14_harmonised_family",
    "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN p_brand ELSE '' END, ''), concat('Unclassified: ', coalesce(p_type, 'unknown'))) AS family, lower(p_name) LIKE '%green%' OR lower(p_name) LIKE '%blue%' AS named FROM part",
)
def _(spark, d):
    family = F.coalesce(F.nullif(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("")), F.lit("")), F.concat(F.lit("Unclassified: "), F.coalesce("p_type", F.lit("unknown"))))
    return table(spark, d, "part").select("p_partkey", family.alias("family"), scalars.contains_any(F.col("p_name"), ["green", "blue"]).alias("named"))


@query(
    "p15_population_masks",
    """WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS p FROM orders),
m AS (SELECT *, 'all' AS population FROM x UNION ALL SELECT *, 'no_exact' FROM x WHERE o_orderstatus <> 'F' UNION ALL SELECT *, 'near_90' FROM x WHERE p < 300000 UNION ALL SELECT *, 'near_95' FROM x WHERE p < 350000)
SELECT population, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS n_open FROM m GROUP BY population""",
)
def _(spark, d):
    p = F.col("o_totalprice")
    masks = F.array(F.lit("all"), F.when(F.col("o_orderstatus") != "F", "no_exact"), F.when(p < 300000, "near_90"), F.when(p < 350000, "near_95"))
    rows = table(spark, d, "orders").select("o_orderstatus", F.explode(F.array_compact(masks)).alias("population"))
    return rows.groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query(
    "j2_composite_join",
    """SELECT l_orderkey, l_linenumber, o_orderpriority, c_mktsegment, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
)
def _(spark, d):
    li, o, c, n, r = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    places = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name")
    people = c.join(places, c.c_nationkey == places.n_nationkey).select("c_custkey", "c_mktsegment", "n_name")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(people, o.o_custkey == people.c_custkey).select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment", "n_name")


@query("j4_right_join", "SELECT s_suppkey, n_name, count(l_orderkey) AS n_lines FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey < 3 LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY s_suppkey, n_name")
def _(spark, d):
    n, s = table(spark, d, "nation").where("n_regionkey < 3"), table(spark, d, "supplier")
    lines = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n_lines"))
    out = n.join(s, n.n_nationkey == s.s_nationkey, "right")
    return out.join(lines, out.s_suppkey == lines.l_suppkey, "left").select("s_suppkey", "n_name", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


@query(
    "j5_outer_diff",
    """WITH a AS (SELECT doc_id, quality AS v FROM labels WHERE toxic = 0), b AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS v FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS presence, a.v IS DISTINCT FROM b.v AS v_differs
FROM a FULL JOIN b USING (doc_id)""",
)
def _(spark, d):
    a = table(spark, d, "labels").where("toxic = 0").select("doc_id", F.col("quality").alias("v"))
    b = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("v"))
    return relational.outer_diff(a, b, ["doc_id"], ["v"])


@query("j7_checked_join", "SELECT doc_id, lang, quality, toxic FROM labels JOIN documents USING (doc_id)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return relational.checked_join(table(spark, d, "labels"), docs, ["doc_id"], validate="one_to_one", require_match=True).select("doc_id", "lang", "quality", "toxic")


@query("j8_anti_semi", "SELECT p_partkey, 'unsold' AS kind FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT p_partkey, 'sold' FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    p, sold = table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(sold, "p_partkey", "left_anti").select("p_partkey", F.lit("unsold").alias("kind")).union(p.join(sold, "p_partkey", "left_semi").select("p_partkey", F.lit("sold")))


@query(
    "j12_prefixed_pair",
    """WITH g AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n, round(avg(c_acctbal), 6) + 0.0 AS m FROM customer GROUP BY ALL)
SELECT a.k, a.n AS building_n, a.m AS building_m, b.n AS machinery_n, b.m AS machinery_m FROM g a JOIN g b ON a.k = b.k AND a.s = 'BUILDING' AND b.s = 'MACHINERY'""",
)
def _(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("m"))
    side = lambda s: relational.prefixed(g.where(F.col("c_mktsegment") == s).drop("c_mktsegment"), s.lower() + "_", ["k"])
    return relational.checked_join(side("BUILDING"), side("MACHINERY"), ["k"], validate="one_to_one")


_INTERVALS = "SELECT event_id AS id, user_id AS k, event_id AS s, event_id + CAST(floor(value) AS BIGINT) AS e, event_type FROM events"


@query(
    "j13_interval_overlap",
    f"WITH i AS ({_INTERVALS}) SELECT a.k, a.id AS left_id, b.id AS right_id FROM i a JOIN i b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e WHERE a.event_type = 'purchase' AND b.event_type = 'click' AND a.s <= a.e AND b.s <= b.e",
)
def _(spark, d):
    i = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value")).alias("end"), "event_type").where("start <= end")
    return relational.interval_overlaps(i.where("event_type = 'purchase'"), i.where("event_type = 'click'"), ["k"], 256)


@query(
    "j15_staged_caliper",
    """WITH t AS (SELECT s_suppkey AS target_id, s_nationkey AS k, s_acctbal AS x FROM supplier), p AS (SELECT c_custkey AS control_id, c_nationkey AS k, c_acctbal AS y FROM customer),
m AS (SELECT target_id, control_id, abs(x - y) AS d, CASE WHEN abs(x - y) <= 200 THEN 1 WHEN abs(x - y) <= 1000 THEN 2 WHEN abs(x - y) <= 20000 THEN 3 END AS stage FROM t JOIN p USING (k) WHERE target_id <> control_id),
c AS (SELECT target_id, count(*) FILTER (WHERE stage <= 1) AS n1, count(*) FILTER (WHERE stage <= 2) AS n2, count(*) FILTER (WHERE stage <= 3) AS n3 FROM m GROUP BY target_id),
u AS (SELECT target_id, CASE WHEN n1 >= 5 THEN 1 WHEN n2 >= 5 THEN 2 WHEN n3 >= 5 THEN 3 END AS stage, CASE WHEN n1 >= 5 THEN n1 WHEN n2 >= 5 THEN n2 WHEN n3 >= 5 THEN n3 END AS pool_size FROM c),
r AS (SELECT m.target_id, control_id, u.stage, u.pool_size, row_number() OVER (PARTITION BY m.target_id ORDER BY d, sha256(m.target_id || '|' || control_id), control_id) AS place FROM m JOIN u ON m.target_id = u.target_id AND m.stage <= u.stage)
SELECT target_id, control_id, stage, pool_size, place FROM r WHERE place <= 8""",
)
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("control_id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("y"))
    tie = F.sha2(F.concat_ws("|", F.col("target_id").cast("string"), F.col("control_id").cast("string")), 256)
    return relational.staged_match(t, p, ["k"], "x", "y", [200, 1000, 20000], 5, 8, tie)


@query(
    "j19_nearest_other_group",
    """WITH m AS (SELECT a.s_suppkey, b.s_suppkey AS other, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a JOIN nation na ON a.s_nationkey = na.n_nationkey JOIN nation nb ON nb.n_regionkey = na.n_regionkey AND nb.n_nationkey <> na.n_nationkey JOIN supplier b ON b.s_nationkey = nb.n_nationkey)
SELECT s_suppkey, arg_min(other, (d, other)) AS nearest, round(min(d), 6) + 0.0 AS distance FROM m GROUP BY s_suppkey""",
)
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", "n_nationkey", "n_regionkey")
    o = s.select(F.col("s_suppkey").alias("other"), F.col("s_acctbal").alias("y"), F.col("n_nationkey").alias("k"), "n_regionkey")
    near = relational.nearest(s, o, ["n_regionkey"], "s_suppkey", "s_acctbal", "other", "y", [20, 200, 2000, 20000], F.col("n_nationkey") != F.col("k"))
    return near.select("s_suppkey", F.col("other").alias("nearest"), F.round("distance", 6).alias("distance"))


@query(
    "j21_alias_resolution",
    """WITH a AS (SELECT DISTINCT lower(p_brand) AS alias, p_brand AS target FROM part UNION SELECT DISTINCT lower(string_split(p_type, ' ')[-1]), p_type FROM part WHERE p_size = 1),
w AS (SELECT p_partkey AS id, [lower(string_split(p_type, ' ')[-1]), lower(p_brand)] AS tokens FROM part),
x AS (SELECT id, unnest(tokens) AS alias, generate_subscripts(tokens, 1) AS i FROM w)
SELECT id, arg_min(target, (i, target)) AS target, count(DISTINCT target) AS n_targets FROM x JOIN a USING (alias) GROUP BY id""",
)
def _(spark, d):
    p = table(spark, d, "part")
    last = F.lower(F.element_at(F.split("p_type", " "), -1))
    names = p.select(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("target")).union(p.where("p_size = 1").select(last, "p_type")).distinct()
    return relational.alias_resolution(p.select(F.col("p_partkey").alias("id"), F.array(last, F.lower("p_brand")).alias("tokens")), names, "id", "tokens")


@query("j23_zero_filled", "SELECT r_name, c_mktsegment, count(c_custkey) AS n FROM (SELECT r_name, r_regionkey FROM region) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN (SELECT c_custkey, c_mktsegment AS seg, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900) ON seg = c_mktsegment AND n_regionkey = r_regionkey GROUP BY ALL")
def _(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    counts = c.where("c_acctbal < -900").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return relational.zero_filled(r.select("r_name"), c.select("c_mktsegment").distinct(), counts, ["r_name", "c_mktsegment"], "n")


@query("j24_pairs_in_group", "SELECT a.n_regionkey AS k, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("a")), n.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("b"))
    return a.join(b, "k").where("a < b")


@query(
    "j25_best_triple",
    """WITH g AS (SELECT n_nationkey AS i, n_regionkey AS r, coalesce(avg(c_acctbal), 0) AS x FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT a.i AS a, b.i AS b, c.i AS c, round(abs((a.x + b.x + c.x) / 3 - 4500), 6) + 0.0 AS objective FROM g a JOIN g b ON a.i < b.i AND a.r <> b.r JOIN g c ON b.i < c.i AND c.r NOT IN (a.r, b.r)
ORDER BY round(abs((a.x + b.x + c.x) / 3 - 4500), 6), a, b, c LIMIT 1""",
)
def _(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    g = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.coalesce(F.avg("c_acctbal"), F.lit(0.0)).alias("x"))
    side = lambda s: g.select(F.col("n_nationkey").alias(s), F.col("n_regionkey").alias("r" + s), F.col("x").alias("x" + s))
    triples = side("a").join(side("b"), F.expr("a < b AND ra <> rb")).join(side("c"), F.expr("b < c AND rc <> ra AND rc <> rb"))
    return triples.select("a", "b", "c", F.round(F.abs((F.col("xa") + F.col("xb") + F.col("xc")) / 3 - 4500), 6).alias("objective")).orderBy("objective", "a", "b", "c").limit(1)


@query("a1_named_aggregation", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, sum(l_linenumber)::BIGINT AS lines, max(l_quantity) AS most, round(avg(l_discount), 8) + 0.0 AS discount, count(*) FILTER (WHERE l_tax > 0.05) AS taxed FROM lineitem GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_linenumber").alias("lines"), F.max("l_quantity").alias("most"), F.round(F.avg("l_discount"), 8).alias("discount"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"))


@query("a5_joined_set", "SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(scalars.joined_set(F.col("p_type")).alias("types"), F.count_distinct("p_type").alias("n"))


@query("a6_group_state", "SELECT source, CASE WHEN sum(quality) = count(*) THEN 'positive_only' WHEN sum(quality) = 0 THEN 'negative_only' ELSE 'mixed' END AS state, sum(quality)::BIGINT AS positives, count(*) AS genes FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def _(spark, d):
    g = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("source", "lang").agg(F.sum("quality").alias("positives"), F.count(F.lit(1)).alias("genes"))
    return g.select("source", scalars.first_match("mixed", positive_only=F.col("positives") == F.col("genes"), negative_only=F.col("positives") == 0).alias("state"), "positives", "genes")


@query("a7_longest_per_group", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def _(spark, d):
    return ordered.best_row(table(spark, d, "documents"), ["source"], F.struct("n_chars", -F.col("doc_id")), "doc_id", "n_chars")


_DECISION = f"""WITH s AS (SELECT c_mktsegment AS task, o_orderstatus AS slug, {_ARM_SQL} AS arm, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT task, slug, arm, avg(o_totalprice) AS v FROM s GROUP BY ALL),
w AS (SELECT task, slug, {', '.join(f"max(v) FILTER (WHERE arm = '{a}') AS {a}" for a in ARMS)} FROM m GROUP BY task, slug),
g AS (SELECT *, greatest(herb, random_arm, matched_arm) AS best, tree - base AS over_base, tree - greatest(herb, random_arm, matched_arm) AS over_best FROM w)"""


def _contrasts(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    s = relational.checked_join(o, c, ["o_custkey"]).select(F.col("c_mktsegment").alias("task"), F.col("o_orderstatus").alias("slug"), arm().alias("arm"), "o_totalprice")
    m = s.groupBy("task", "slug", "arm").agg(F.avg("o_totalprice").alias("v"))
    w = relational.complete_pivot(m, ["task", "slug"], "arm", list(ARMS), "v")
    best = F.greatest(*CONTROLS)
    return w.select("*", best.alias("best"), scalars.first_largest(**{k: F.col(k) for k in CONTROLS}).alias("best_name"), (F.col("tree") - F.col("base")).alias("over_base"), (F.col("tree") - best).alias("over_best"))


@query("a10_arm_contrasts", _DECISION + " SELECT task, slug, round(best, 4) + 0.0 AS best, CASE WHEN best = herb THEN 'herb' WHEN best = random_arm THEN 'random_arm' ELSE 'matched_arm' END AS best_name, round(over_base, 4) + 0.0 AS over_base, round(over_best, 4) + 0.0 AS over_best FROM g")
def _(spark, d):
    return _contrasts(spark, d).select("task", "slug", F.round("best", 4).alias("best"), "best_name", F.round("over_base", 4).alias("over_base"), F.round("over_best", 4).alias("over_best"))


@query(
    "i5_decision_gate",
    _DECISION + """, t AS (SELECT task, avg(over_best) AS m, min(over_best) AS lo FROM g GROUP BY task)
SELECT count(*) FILTER (WHERE m > 0) AS positive_tasks, count(*) FILTER (WHERE m < -2000) AS reversals, round(min(lo), 4) + 0.0 AS worst,
CASE WHEN count(*) FILTER (WHERE m > 0) >= 3 AND count(*) FILTER (WHERE m < -2000) = 0 THEN 'continue_full_multiseed' ELSE 'stop' END AS decision FROM t""",
)
def _(spark, d):
    from weft.operators.integrity import decision

    t = _contrasts(spark, d).groupBy("task").agg(F.avg("over_best").alias("m"), F.min("over_best").alias("lo"))
    return decision(t, F.col("m") > 0, 3, F.col("m") < -2000, F.round(F.min("lo"), 4).alias("worst"))


@query("a12_crosstab", "SELECT lang, coalesce(count(*) FILTER (WHERE quality = 0), 0) AS q0, coalesce(count(*) FILTER (WHERE quality = 1), 0) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return relational.crosstab(x, "lang", "quality", [0, 1]).select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"))


@query("a13_unpivot", "SELECT s_suppkey, measure, value FROM (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier) UNPIVOT (value FOR measure IN (balance, nation))")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")).unpivot("s_suppkey", ["balance", "nation"], "measure", "value")


@query("a14_scope_sets", "SELECT coalesce(event_type, 'all') AS scope, count(*) AS n, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY GROUPING SETS ((), (event_type))")
def _(spark, d):
    e = table(spark, d, "events").groupingSets([[], ["event_type"]], "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean")).select(F.coalesce("event_type", F.lit("all")).alias("scope"), "n", "median", "mean")


@query(
    "a15_scopes_with_two_classes",
    """WITH x AS (SELECT lang, source, quality, doc_id FROM documents JOIN labels USING (doc_id))
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, sum(quality)::BIGINT AS positives FROM x GROUP BY GROUPING SETS ((), (lang), (lang, source)) HAVING count(*) >= 4 AND count(DISTINCT quality) = 2""",
)
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    g = x.groupingSets([[], ["lang"], ["lang", "source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("positives"), F.count_distinct("quality").alias("k"))
    return g.where("n >= 4 AND k = 2").select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "positives")


@query("a21_conflict_exclusion", "SELECT l_orderkey, min(l_returnflag) AS call, max(l_quantity) AS strongest, min(abs(l_discount)) AS weakest FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("call"), F.max("l_returnflag").alias("other"), F.max("l_quantity").alias("strongest"), F.min(F.abs("l_discount")).alias("weakest"))
    return g.where("call = other").drop("other")


@query("a22_consensus_fractions", "WITH t AS (SELECT n_regionkey AS k, count(DISTINCT s_suppkey) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_regionkey AS k, p_size, count(DISTINCT s_suppkey) AS detected, total, round(count(DISTINCT s_suppkey) / total, 8) + 0.0 AS fraction FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN t ON t.k = n_regionkey GROUP BY n_regionkey, p_size, total")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("k"))
    total = s.groupBy("k").agg(F.count_distinct("s_suppkey").alias("total"))
    li, p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), table(spark, d, "part").select("p_partkey", "p_size")
    seen = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("k", "p_size").agg(F.count_distinct("s_suppkey").alias("detected"))
    return seen.join(total, "k").select("k", "p_size", "detected", "total", F.round(F.col("detected") / F.col("total"), 8).alias("fraction"))


@query("a25_weighted_share", "WITH g AS (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT c_mktsegment, n_name, n, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 8) + 0.0 AS share FROM g")
def _(spark, d):
    g = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return g.select("c_mktsegment", "n_name", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")), 8).alias("share"))


@query("a26_presence_fraction", "WITH h AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), f AS (SELECT c_nationkey, o_orderpriority, count(*)::DOUBLE AS n FROM h JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY 1), x AS (SELECT o_orderpriority, s.c_nationkey, coalesce(f.n, 0) / total AS fr FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN s LEFT JOIN f USING (c_nationkey, o_orderpriority)) SELECT o_orderpriority AS family, round(avg(fr), 8) + 0.0 AS mean_fraction FROM x GROUP BY 1")
def _(spark, d):
    h = table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    f = h.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"))
    x = relational.zero_filled(h.select("o_orderpriority").distinct(), s, f, ["c_nationkey", "o_orderpriority"], "n")
    return x.groupBy(F.col("o_orderpriority").alias("family")).agg(F.round(F.avg(F.col("n") / F.col("total")), 8).alias("mean_fraction"))


@query("w1_rolling_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) + 0.0 AS rolling FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("rolling"))


@query("w2_average_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY d) + (count(*) OVER (PARTITION BY o_orderpriority, d) - 1) / 2 AS r FROM (SELECT o_orderkey, o_orderpriority, floor(o_totalprice / 1000) AS d FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return ordered.average_ranks(o, ["o_orderpriority"], "v", "r").select("o_orderkey", "r")


@query("w4_equal_count_bins", "SELECT doc_id, floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 10 / count(*) OVER ())::BIGINT AS decile FROM documents")
def _(spark, d):
    return ordered.equal_count_bins(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 10, "decile").select("doc_id", "decile")


@query("w7_neighbour_window", "SELECT p_partkey, list(p_partkey) OVER w AS near, count(*) OVER w < 21 AS edge FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)")
def _(spark, d):
    from weft.operators.graph import neighbour_window

    return neighbour_window(table(spark, d, "part"), ["p_brand"], "p_partkey", 10).select("p_partkey", F.col("window").alias("near"), "edge")


@query("w10_hash_top_n", "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('v4|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def _(spark, d):
    x = table(spark, d, "documents").select("lang", "source", "doc_id", F.sha2(F.concat_ws("|", F.lit("v4"), F.col("doc_id").cast("string")), 256).alias("_h"))
    return ordered.top_per_group(x, ["lang", "source"], ["_h", "doc_id"], 5).select("lang", "source", "doc_id")


@query("w11_global_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("w14_proportional_allocation", "SELECT n_nationkey, floor(1003 / count(*) OVER ())::BIGINT + CASE WHEN row_number() OVER (ORDER BY n_nationkey) <= 1003 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM nation")
def _(spark, d):
    from weft.operators.sampling import allocate

    return allocate(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], 1003)


@query("u2_common_keys", "SELECT doc_id FROM documents WHERE n_chars > 100 INTERSECT SELECT doc_id FROM labels INTERSECT SELECT conv_id FROM conversations")
def _(spark, d):
    a, b, c = table(spark, d, "documents").where("n_chars > 100").select("doc_id"), table(spark, d, "labels").select("doc_id"), table(spark, d, "conversations").select("conv_id")
    return a.intersect(b).intersect(c)


@query("u3_missing_from_product", "SELECT c_mktsegment, n_nationkey FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN nation EXCEPT SELECT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 8000")
def _(spark, d):
    c = table(spark, d, "customer")
    expected = c.select("c_mktsegment").distinct().join(table(spark, d, "nation").select("n_nationkey"), how="cross")
    return relational.missing_keys(expected, c.where("c_acctbal > 8000").select("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).distinct())


@query("u6_exploded_list", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("m1_hash_split", "SELECT doc_id, ('0x' || substr(sha256('split|' || doc_id), 1, 8))::BIGINT % 100 AS bucket, ('0x' || substr(sha256('split|' || doc_id), 1, 8))::BIGINT % 100 = 0 AS validation FROM documents")
def _(spark, d):
    b = hashing.bucket(100, F.lit("split"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", b.alias("bucket"), (b == 0).alias("validation"))
