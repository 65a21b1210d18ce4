"""Secret scans with corpus-wide ownership of candidates, DataFrame operations only.

Base candidates are leftmost, non-overlapping matches of three patterns; a match that
is too short is dropped after it has consumed its text. The method then counts, for
every candidate value's hash, the distinct repositories and owners that hold it, over
the whole corpus. A value found under several owners is a widely copied example; one
held by a single owner and made of mixed characters looks live. Where a live-looking
value of one owner also stands bare elsewhere in that owner's documents (a run of the
values' characters that no base pattern matched, or a part of it between '=', between
'=' and '/', or between those and '.'), those places are added as spans of kind `owned`.
Dots at the end of a value are punctuation and count for nothing when values are
compared. Base spans are never taken away.

Positions come from marking matches with two control characters and adding up the
lengths between the marks, in stretches, so that the work is linear in a text's matches;
the same characters in the text are first replaced by another that no pattern matches.
A bare run is cut into parts as a row of its own, and whether an owned place overlaps a
base span is seen in one order of both by place, so a list of a hundred thousand digests
costs what its length says.

Counting is two grouped sums (value and owner and repository, then value), each
combined before its shuffle, so one value in a third of all documents is one row for
each task. Bare words meet owned values in a join on hash and owner that Spark can
split when skewed.

Edge cases: null and empty texts have no spans; rows without doc_id are left out; a
null owner counts as the owner ''; a doc_id that occurs twice gives a row for each
occurrence; an empty table gives an empty result; columns other than doc_id, text and
the owner column are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import table

#: The base patterns, each with the group that is measured and its least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OPEN, CLOSE, PLAIN = "\x01", "\x02", "\x03"
#: A bare word that could be a credential; values of other shapes are not looked for outside the base patterns.
BARE = r"[A-Za-z0-9+/_.=-]{16,}"
#: Runs are looked for where they begin only, which changes no match and spares the places inside them; a bare run needs a digit and a letter.
STARTS = {"hex": "(?<![0-9a-f])", "bare": "(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])"}
#: What a bare run is cut at, one way after the other, beside being taken whole.
CUTS = ("=", "[=/]", "[=/.]")
LEAST, STRETCH = 16, 256
SPAN = "struct<start:int,end:int,kind:int,value:string>"


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """The text split where a match of the pattern begins, the match and its group closed by marks; one piece if it has none."""
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}${group}{CLOSE}" if group else f"{OPEN}$0{CLOSE}$0{CLOSE}")
    return F.split(marked, OPEN, -1)


def _spans(pieces: Column, kind: int, least: int) -> Column:
    """array<struct<start,end,kind,value>> of the matches whose group has `least` characters. `pieces` has to be a column, as it is read once a stretch."""
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        parts = F.split(piece, CLOSE, -1)
        has = F.size(parts) == 3
        whole, value, rest = F.when(has, parts[0]).otherwise(""), F.when(has, parts[1]).otherwise(""), F.when(has, parts[2]).otherwise(parts[0])
        end = acc.at + F.length(whole)
        span = F.struct(acc.at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value")).cast(SPAN)
        return F.struct((end + F.length(rest)).alias("at"), F.when(has & (F.length(value) >= least), F.concat(acc.found, F.array(span))).otherwise(acc.found).alias("found"))

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STRETCH).cast("int")), lambda k: F.aggregate(F.slice(pieces, k * STRETCH + 1, F.lit(STRETCH)), start, step))
    return F.when(F.size(pieces) > 1, stretches)


def _moved(stretches: Column) -> Column:
    """The spans of all stretches, each moved by the length of those before it."""
    places = F.aggregate(stretches, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct((acc.at + x.at).alias("at"), F.concat(acc.all, F.array(acc.at)).alias("all")), lambda acc: acc.all)
    moved = F.zip_with(stretches, places, lambda x, at: F.transform(x.found, lambda s: F.struct((s.start + at).alias("start"), (s.end + at).alias("end"), s.kind.alias("kind"), s.value.alias("value"))))
    return F.coalesce(F.flatten(moved), F.array().cast(f"array<{SPAN}>"))


def _may_hold(text: Column, name: str) -> Column:
    """Whether a text can hold a match at all, by plain searches; others are not marked."""
    if name == "assign":
        low = F.lower(text)
        return functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in ("passw", "secret", "token", "api")])
    return F.contains(text, F.lit("AKIA")) if name == "access" else F.lit(True)


def _stem(value: Column) -> Column:
    """A value without dots at its end."""
    return F.regexp_replace(value, r"\.+$", "")


def _credential_like(value: Column) -> Column:
    return (F.length(value) >= LEAST) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def candidates(found: DataFrame) -> DataFrame:
    """(row, owner, start, end, value), without repeats: of the bare runs of every row the runs and their parts that look like credentials, without dots at their ends."""
    runs = found.select("row", "owner", F.explode("runs").alias("r")).select("row", "owner", F.col("r.start").alias("at"), F.col("r.value").alias("value"))
    ways = F.array(F.array("value"), *[F.when(F.col("value").rlike(c), F.split("value", c, -1)) for c in CUTS])  # every cut is one character wide
    split = runs.select("row", "owner", "at", F.explode(ways).alias("words")).where("words IS NOT NULL")
    # starts of the words, by stretches
    lengths = split.withColumn("n", F.transform("words", lambda w: F.length(w) + 1))
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size("n") - 1) / STRETCH).cast("int")), lambda k: F.struct(F.slice("words", k * STRETCH + 1, F.lit(STRETCH)).alias("words"), F.aggregate(F.slice("n", k * STRETCH + 1, F.lit(STRETCH)), F.lit(0), lambda a, x: a + x).alias("n")))
    stretches = lengths.select("row", "owner", "at", each.alias("s"))
    before = F.aggregate("s", F.struct(F.col("at").alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct((acc.at + x.n).alias("at"), F.concat(acc.all, F.array(acc.at)).alias("all")), lambda acc: acc.all)
    one = stretches.select("row", "owner", F.explode(F.arrays_zip(F.col("s.words").alias("words"), before.alias("at"))).alias("s")).select("row", "owner", "s.words", "s.at")
    first = F.struct(F.col("at").alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("found"))
    step = lambda acc, w: F.struct((acc.at + F.length(w) + 1).alias("at"), F.when(F.length(w) >= LEAST, F.concat(acc.found, F.array(F.struct(acc.at.alias("start"), _stem(w).alias("value"))))).otherwise(acc.found).alias("found"))
    parts = one.select("row", "owner", F.explode(F.aggregate("words", first, step, lambda acc: acc.found)).alias("p")).select("row", "owner", "p.start", "p.value")
    return parts.where(_credential_like(F.col("value"))).select("row", "owner", "start", (F.col("start") + F.length("value")).alias("end"), "value").distinct()


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, owner, spans, runs): base spans of every row, and its bare runs with their places."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), OPEN + CLOSE, PLAIN + PLAIN)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), text.alias("t"))
    looked = [(k, f"p{k}", F.when(_may_hold(F.col("t"), name), _pieces(F.col("t"), STARTS.get(name, "") + p, g)), n) for k, (name, p, g, n) in enumerate(PATTERNS)]
    looked.append((len(PATTERNS), f"p{len(PATTERNS)}", _pieces(F.col("t"), STARTS["bare"] + BARE, 0), LEAST))
    pieces = rows.select("doc_id", "owner", *[c.alias(name) for _, name, c, _ in looked])
    stretches = pieces.select("doc_id", "owner", *[_spans(F.col(name), k, n).alias(f"s{k}") for k, name, _, n in looked])
    return stretches.select("doc_id", "owner", F.concat(*[_moved(F.col(f"s{k}")) for k in range(len(PATTERNS))]).alias("spans"), _moved(F.col(f"s{len(PATTERNS)}")).alias("runs"))


def value_hash(value: Column) -> Column:
    return F.substring(F.sha2(_stem(value), 256), 1, 32)


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories, uses, owner, live): how widely each base candidate value is held.

    A repository is a document here; `owner` is the only owner where owners = 1.
    """
    each = found.select("doc_id", "owner", F.explode("spans").alias("s")).select("doc_id", "owner", value_hash(F.col("s.value")).alias("value_hash"), _credential_like(_stem(F.col("s.value"))).alias("live"))
    held = each.groupBy("value_hash", "owner", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.first("live").alias("live"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"), F.first("live").alias("live"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"), F.min("owner").alias("owner"), F.first("live").alias("live"))


def _outside(places: DataFrame, base: DataFrame) -> DataFrame:
    """Of (row, start, end, ...) those that overlap no (row, start, end) of base, by one order of both in each row."""
    both = places.withColumn("base", F.lit(False)).unionByName(base.withColumn("base", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("row").orderBy("start", F.desc("base"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1))
    seen = both.withColumns({"before": before, "after": after})
    return seen.where(~F.col("base") & (F.col("before").isNull() | (F.col("before") <= F.col("start"))) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))).select(*places.columns)


def secret_spans(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, spans (base and added, sorted), and how many base spans are held by one or several owners."""
    found = checkpoint(scan(docs, owner).withColumn("row", F.monotonically_increasing_id()))
    held = checkpoint(ownership(found))
    spans = found.select("row", F.explode("spans").alias("s"))
    counts = spans.withColumn("value_hash", value_hash(F.col("s.value"))).join(held, "value_hash").groupBy("row").agg(F.count_if(F.col("owners") > 1).alias("n_copied"), F.count_if((F.col("owners") == 1) & F.col("live")).alias("n_live"))
    owned = held.where("owners = 1 AND live").select("value_hash", "owner")
    bare = candidates(found).withColumn("value_hash", value_hash(F.col("value"))).join(owned, ["value_hash", "owner"]).select("row", "start", "end", "value")
    placed = spans.select("row", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    # rows without a candidate have nothing to compare
    placed = placed.join(bare.select("row").distinct(), "row", "left_semi")
    span = F.struct("start", "end", F.lit(len(PATTERNS)).alias("kind"), "value").cast(SPAN)
    added = _outside(bare, placed).groupBy("row").agg(F.collect_list(span).alias("added"))
    out = found.join(counts, "row", "left").join(added, "row", "left")
    every = F.concat("spans", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", _by_place(F.col("spans")).alias("base"), _by_place(every).alias("spans"), F.coalesce("n_copied", zero).alias("n_copied"), F.coalesce("n_live", zero).alias("n_live"))


def _by_place(spans: Column) -> Column:
    """Spans by start, then kind."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value"))))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in PATTERNS], F.lit("owned"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), "n_copied", "n_live")


def _marked_sql(kind: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""m{kind} AS (SELECT doc_id, owner, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(2) || '\\{group}' || chr(2), 'g'), chr(1)) AS x FROM t),
l{kind} AS (SELECT doc_id, owner, list_transform(x, lambda p: string_split(p, chr(2))) AS x FROM m{kind} WHERE len(x) > 1),
s{kind} AS (SELECT doc_id, owner, {kind} AS kind, list_sum(list_transform(x[1:i - 1], lambda p: length(p[1]) + coalesce(length(p[3]), 0))) AS a, x[i][1] AS whole, x[i][2] AS value FROM (SELECT doc_id, owner, x, unnest(range(2, len(x) + 1)) AS i FROM l{kind}) WHERE length(x[i][2]) >= {least})"""


OP9_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents WHERE doc_id IS NOT NULL),
{_marked_sql(0, *PATTERNS[0][1:])},
{_marked_sql(1, *PATTERNS[1][1:])},
{_marked_sql(2, *PATTERNS[2][1:])},
{_marked_sql(3, BARE, 0, LEAST)},
base AS (SELECT doc_id, owner, kind, CAST(a AS BIGINT) AS a, CAST(a + length(whole) AS BIGINT) AS z, rtrim(value, '.') AS value, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND length(rtrim(value, '.')) >= {LEAST} AS live FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
held AS (SELECT value, count(DISTINCT owner) AS owners, min(owner) AS owner, bool_or(live) AS live FROM base GROUP BY value),
cut AS (SELECT doc_id, owner, a, string_split_regex(value, c) AS w FROM s3, unnest(['!', {", ".join(f"'{c}'" for c in CUTS)}]) x(c)),
part AS (SELECT doc_id, owner, a + coalesce(list_sum(list_transform(w[1:i - 1], lambda p: length(p) + 1)), 0) AS a, rtrim(w[i], '.') AS value FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM cut)),
bare AS (SELECT DISTINCT doc_id, owner, 3 AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(value) AS BIGINT) AS z, value FROM (SELECT doc_id, owner, a, value FROM part) WHERE length(value) >= {LEAST} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
added AS (SELECT b.doc_id, b.kind, b.a, b.z FROM bare b JOIN held h ON h.value = b.value AND h.owners = 1 AND h.live AND h.owner = b.owner WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.a < b.z AND b.a < x.z)),
named AS (SELECT doc_id, kind, a, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || z AS s FROM (SELECT doc_id, kind, a, z FROM base UNION ALL SELECT * FROM added)),
j AS (SELECT doc_id, string_agg(s, ',' ORDER BY a, kind) AS spans, string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex FROM named GROUP BY doc_id),
o AS (SELECT b.doc_id, count(*) FILTER (WHERE owners > 1) AS n_copied, count(*) FILTER (WHERE owners = 1 AND h.live) AS n_live FROM base b JOIN held h USING (value) GROUP BY b.doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN j USING (doc_id) LEFT JOIN o USING (doc_id)
"""
