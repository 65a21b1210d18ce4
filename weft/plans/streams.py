"""Queries over event windows, run on the table; tests run the same operators as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.registry import query, table
from weft.streaming import events


@query("x1_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.tumbling(e, "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "x2_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e, "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("s26_page_reports", "SELECT page_id, nullif(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '(?i)<a '))::BIGINT AS links, sha256(html) AS digest, strlen(html) AS bytes FROM pages")
def _(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(h, "(?i)<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.regexp_count(h, F.lit("(?i)<a ")).cast("long").alias("links"), F.sha2(h, 256).alias("digest"), F.octet_length(h).cast("long").alias("bytes"))


@query("m14_json_fallbacks", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.ref'), json_extract_string(props, '$.page'), 'none') AS k FROM events")
def _(spark, d):
    j = lambda p: F.get_json_object("props", p)
    return table(spark, d, "events").select("event_id", F.coalesce(j("$.k"), j("$.ref"), j("$.page"), F.lit("none")).alias("k"))


@query("m13_time_order", "SELECT conv.o_orderkey, conv.o_orderdate < max(l_shipdate) AS in_order FROM orders conv JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def _(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return table(spark, d, "orders").join(last, "o_orderkey").select("o_orderkey", (F.col("o_orderdate") < F.col("last")).alias("in_order"))
