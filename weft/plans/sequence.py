"""Queries over sequences, intervals and k-mers; texts stand in for sequences, letters mapped to A, C, G, T and N."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import hashing, scalars
from weft.functions import sequence as seq
from weft.operators import intervals, ordered, sampling
from weft.plans.registry import query, table

ALPHABET, LETTERS = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
_DNA = f"regexp_replace(translate(lower(text), '{ALPHABET}', '{LETTERS}'), '[^ACGT]', 'N', 'g')"
_D = f"WITH d AS (SELECT doc_id, source, lang, {_DNA} AS s FROM documents)"


def dna(spark, d):
    s = F.regexp_replace(F.translate(F.lower("text"), ALPHABET, LETTERS), "[^ACGT]", "N")
    return table(spark, d, "documents").select("doc_id", "source", "lang", s.alias("s"))


def _places(m):
    return f"list_filter(range(1, greatest(length(s) - {len(m) - 1}, 0) + 1), lambda i: substr(s, i, {len(m)}) = '{m}')"


@query("c1_reverse_complement", _D + " SELECT doc_id, sha256(reverse(translate(s, 'ACGT', 'TGCA'))) AS digest FROM d")
def _(spark, d):
    return dna(spark, d).select("doc_id", F.sha2(seq.reverse_complement(F.col("s")), 256).alias("digest"))


@query("c2_overlapping_count", _D + f" SELECT doc_id, len({_places('ACA')})::BIGINT AS aca, len({_places('AA')})::BIGINT AS aa FROM d")
def _(spark, d):
    s = F.col("s")
    return dna(spark, d).select("doc_id", seq.overlapping_count(s, "ACA").alias("aca"), seq.overlapping_count(s, "AA").alias("aa"))


@query("c3_nonoverlapping_starts", _D + " SELECT doc_id, list_transform(range(1, len(string_split(s, 'ACA'))), lambda i: list_sum(list_transform(string_split(s, 'ACA')[1:i], lambda p: length(p)))::BIGINT + (i - 1) * 3 + 1) AS starts FROM d WHERE length(s) < 100000000")
def _(spark, d):
    return dna(spark, d).select("doc_id", seq.nonoverlapping_starts(F.col("s"), "ACA").alias("starts"))


@query("c4_sites", _D + f" SELECT doc_id, unnest({_places('CACG')})::BIGINT AS start1, unnest({_places('CACG')})::BIGINT + 3 AS end1 FROM d")
def _(spark, d):
    x = dna(spark, d).select("doc_id", F.explode(seq.overlapping_starts(F.col("s"), "CACG")).alias("p"))
    return x.select("doc_id", F.col("p").cast("long").alias("start1"), (F.col("p") + 3).cast("long").alias("end1"))


@query("c5_motif_family", _D + f" SELECT doc_id, len({_places('CACGTG')})::BIGINT AS gbox, len({_places('CACG')}) + len({_places('CGTG')}) AS core, len({_places('CACGTG')}) > 0 AS present FROM d")
def _(spark, d):
    c = seq.strand_counts(F.col("s"), ["CACGTG", "CACG"])
    return dna(spark, d).select("doc_id", c["CACGTG"].alias("gbox"), c["CACG"].alias("core"), (c["CACGTG"] > 0).alias("present"))


@query(
    "c6_composition",
    _D + """, n AS (SELECT doc_id, s, length(s) - length(translate(s, 'GC', '')) AS gc, length(s) - length(translate(s, 'ACGT', '')) AS b, (length(s) - length(replace(s, 'CG', ''))) / 2 AS cg FROM d)
SELECT doc_id, round(gc / nullif(b, 0), 8) + 0.0 AS gc, CASE WHEN length(s) > 1 THEN round(cg / (length(s) - 1), 8) + 0.0 END AS cpg_positions, CASE WHEN b > 1 THEN round(cg / (b - 1), 8) + 0.0 END AS cpg_bases FROM n""",
)
def _(spark, d):
    s = F.col("s")
    return dna(spark, d).select("doc_id", F.round(seq.gc_fraction(s), 8).alias("gc"), F.round(seq.cpg_fraction(s), 8).alias("cpg_positions"), F.round(seq.cpg_fraction(s, "bases"), 8).alias("cpg_bases"))


def _kmers(k):
    return f"""k AS (SELECT doc_id, source, unnest(list_transform(range(1, greatest(length(s) - {k - 1}, 0) + 1), lambda i: substr(s, i, {k}))) AS w FROM d),
v AS (SELECT doc_id, source, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM k WHERE NOT contains(w, 'N'))"""


@query("c8_kmer_frequencies", _D + ", " + _kmers(4) + " SELECT source, kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) + 0.0 AS frequency FROM v GROUP BY source, kmer")
def _(spark, d):
    from pyspark.sql import Window

    c = seq.kmer_counts(dna(spark, d).select("source", "s"), "source", "s", 4).groupBy("source", "code").agg(F.sum("n").alias("n"))
    return c.select("source", seq.kmer_text(F.col("code"), 4).alias("kmer"), "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 9).alias("frequency"))


@query("a20_repeat_fraction", _D + ", " + _kmers(9) + ", c AS (SELECT kmer, count(*) AS n FROM v GROUP BY kmer) SELECT count(*) AS distinct_kmers, sum(n)::BIGINT AS windows, round(sum(n) FILTER (WHERE n >= 10) / sum(n), 9) + 0.0 AS repetitive FROM c")
def _(spark, d):
    c = seq.kmer_counts(dna(spark, d), "doc_id", "s", 9).groupBy("code").agg(F.sum("n").alias("n"))
    # a histogram of counts is all that meets in one task
    h = c.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum(F.col("n") * F.col("k"))
    return h.agg(F.sum("k").alias("distinct_kmers"), total.alias("windows"), F.round(F.sum(F.when(F.col("n") >= 10, F.col("n") * F.col("k"))) / total, 9).alias("repetitive"))


@query("c9_mutated", _D + " SELECT doc_id, sha256(replace(s, 'CACG', 'CCAG')) AS digest, (length(s) - length(replace(s, 'CACG', ''))) // 4 AS sites FROM d")
def _(spark, d):
    s = F.col("s")
    starts = seq.nonoverlapping_starts(s, "CACG")
    return dna(spark, d).select("doc_id", F.sha2(seq.mutated(s, starts, "CACG"), 256).alias("digest"), F.size(starts).cast("long").alias("sites"))


@query("c12_chunks", _D + " SELECT doc_id, i AS chunk, length(substr(s, i * 512 + 1, 512)) AS n, sha256(substr(s, i * 512 + 1, 512)) AS digest FROM d, range(0, 4) r(i) WHERE length(s) >= 2048")
def _(spark, d):
    x = dna(spark, d).where(F.length("s") >= 2048).select("doc_id", F.posexplode(seq.chunks(F.col("s"), 512, 4)).alias("chunk", "c"))
    return x.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("digest"))


@query("c13_safe_identifier", "SELECT p_partkey, regexp_replace(p_brand || '_' || p_name, '[^A-Za-z0-9_]+', '_', 'g') || '_' || substr(sha256(p_brand || '|' || p_name), 1, 10) AS safe_id FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.safe_identifier(F.col("p_brand"), F.col("p_name")).alias("safe_id"))


@query("c15_delimited_sum", "SELECT event_id, round(list_sum(list_transform(string_split(event_id || ',' || user_id || ',x,' || value, ','), lambda x: coalesce(try_cast(trim(x) AS DOUBLE), 0.0))), 6) + 0.0 AS total FROM events")
def _(spark, d):
    cell = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("x"), F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", F.round(scalars.delimited_sum(cell), 6).alias("total"))


@query("c20_required_phrases", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS words, contains(text, 'License') AS licensed, regexp_matches(text, '(?i)copyright') AS copyright FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("words"), F.contains("text", F.lit("License")).alias("licensed"), F.col("text").rlike("(?i)copyright").alias("copyright"))


@query(
    "a16_n50",
    """WITH x AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS c, sum(n_chars) OVER (PARTITION BY source) AS t FROM documents)
SELECT source, max(n_chars) FILTER (WHERE c * 2 >= t) AS n50, count(*) AS contigs, max(t)::BIGINT AS total FROM x GROUP BY source""",
)
def _(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    c = ordered.running_sums(x, ["source"], [F.desc("n_chars"), "doc_id"], {"c": "n_chars"})
    t = x.groupBy("source").agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("contigs"))
    return c.join(t, "source").where("c * 2 >= total").groupBy("source", "contigs", "total").agg(F.max("n_chars").alias("n50"))


@query("a17_composition_by_source", _D + " SELECT source, sum(length(s))::BIGINT AS n, sum(length(s) - length(replace(s, 'N', '')))::BIGINT AS ambiguous, sum(coalesce(list_sum(list_transform(regexp_extract_all(s, '[ACGT]+'), lambda r: greatest(0, length(r) - 20))), 0))::BIGINT AS valid_21mers FROM d GROUP BY source")
def _(spark, d):
    s = F.col("s")
    runs = F.aggregate(F.split(s, "N+"), F.lit(0).cast("long"), lambda a, r: a + F.greatest(F.lit(0), F.length(r) - 20))
    return dna(spark, d).groupBy("source").agg(F.sum(F.length(s)).alias("n"), F.sum(seq.count_of(s, "N")).alias("ambiguous"), F.sum(runs).alias("valid_21mers"))


_I = "WITH i AS (SELECT user_id AS k, event_id AS s, event_id + CAST(floor(value) AS BIGINT) AS e FROM events WHERE floor(value) >= 0)"


@query(
    "a18_union_length",
    _I + """, p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
q AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p),
r AS (SELECT k, island, max(e) - min(s) + 1 AS n FROM q GROUP BY ALL) SELECT k, sum(n)::BIGINT AS covered FROM r GROUP BY k""",
)
def _(spark, d):
    i = table(spark, d, "events").where("floor(value) >= 0").select(F.col("user_id").alias("k"), F.col("event_id").alias("s"), (F.col("event_id") + F.floor("value")).alias("e"))
    return intervals.union_length(i, ["k"], "s", "e")


@query("a24_density", "SELECT event_type, greatest(0, least(9, floor(value / 20)))::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return intervals.density(table(spark, d, "events"), ["event_type"], "value", 0, 200, 10)


@query(
    "d1_sampled_windows",
    _D + """, c AS (SELECT lang, doc_id, length(s) AS size, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS start0 FROM d WHERE length(s) >= 512),
w AS (SELECT lang, doc_id, size, start0, count(*) FILTER (WHERE c = 'N') OVER (PARTITION BY doc_id ORDER BY start0 ROWS BETWEEN CURRENT ROW AND 511 FOLLOWING) AS n FROM c),
f AS (SELECT lang, doc_id, start0, count(*) OVER (PARTITION BY lang) AS eligible, row_number() OVER (PARTITION BY lang ORDER BY sha256('w1|' || doc_id || '|' || start0), doc_id, start0) AS place FROM w WHERE start0 + 512 <= size AND n <= 0.2 * 512)
SELECT lang, doc_id, start0::BIGINT AS start0, eligible, place FROM f WHERE place <= 200""",
)
def _(spark, d):
    return sampling.sample_windows(dna(spark, d), "doc_id", "s", 512, 0.2, 200, "w1", ["lang"]).select("lang", "doc_id", "start0", "eligible", "place")


@query(
    "d2_equal_budget_cohorts",
    """WITH k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('d2|' || lang || '|' || doc_id), doc_id) AS k FROM documents WHERE lang IN ('en', 'de', 'fr', 'es'))
SELECT lang AS cohort, lang, doc_id FROM k WHERE k <= 30 UNION ALL SELECT 'union', lang, doc_id FROM k WHERE k <= CASE WHEN lang IN ('en', 'de') THEN 8 ELSE 7 END""",
)
def _(spark, d):
    return sampling.equal_budget_cohorts(table(spark, d, "documents"), "lang", "doc_id", ["en", "de", "fr", "es"], 30, "d2")


@query("d3_shard_audit", _D + " SELECT count(*) AS n, count(*) FILTER (WHERE length(s) >= 512) AS long_enough, count(*) FILTER (WHERE regexp_matches(s, '^[ACGTN]*$')) AS clean, count(*) - count(DISTINCT s) AS repeats FROM d")
def _(spark, d):
    # distinct by digest, so no text is shuffled
    x = dna(spark, d).select(F.length("s").alias("n"), F.col("s").rlike("^[ACGTN]*$").alias("ok"), F.sha2("s", 256).alias("h"))
    g = x.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") >= 512).alias("a"), F.count_if("ok").alias("b"))
    return g.agg(F.sum("k").alias("n"), F.sum("a").alias("long_enough"), F.sum("b").alias("clean"), (F.sum("k") - F.count(F.lit(1))).alias("repeats"))


@query("d5_split_by_source", "SELECT doc_id, CASE WHEN source IN ('src18', 'src19') THEN 'test' WHEN source IN ('src16', 'src17') THEN 'development' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    return sampling.split_by(table(spark, d, "documents").select("doc_id", "source"), F.col("source").isin("src16", "src17"), F.col("source").isin("src18", "src19")).select("doc_id", "split")
