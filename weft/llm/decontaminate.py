"""Benchmark decontamination as a prefix-filtered set join, DataFrame operations only.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters. An
item's windows are its runs of `window` = 10 words (the whole item if it has fewer).
A window is a set of positioned shingles (three words; fewer for shorter windows) that
has to be contained whole, so a prefix of one shingle is necessary: the rarest.

Two passes over the documents. The first counts how often each item shingle occurs
(one row a shingle and task leaves it); shingles are ordered by that, and each window
keeps its rarest as prefix, or is given up if one of its shingles is nowhere. The
second meets the documents with the prefixes alone: the window's place follows from the
shingle's (positional bound), it must lie inside the document (length bound), and then
all its words are compared at once, so only true hits leave the pass. It also counts
each document's words.

The item side is cut into blocks of at most `block_shingles` shingles, and only such a
block is broadcast, so its size is bounded whatever the number of items; there are two
passes for each block.

Documents are never joined to each other and item shingles are distinct, so a passage
in a third of all documents costs each of them its own rows and no more.

Edge cases: null and empty texts have no words; items without words have no windows;
rows without doc_id or item_id are left out; repeated items count once; rows that share
a doc_id are judged each by its own text; empty tables give zero hits or an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import rows_by, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words, with A-Z counted as word characters since they are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BLOCK_SHINGLES = 500_000
HITS = "array<struct<start:int,end:int,item_ids:array<bigint>>>"


def words(low: Column) -> Column:
    """The words of a text in lower case."""
    parts = F.split(low, BETWEEN)
    first = F.when(parts[0] == "", 2).otherwise(1)
    return F.slice(parts, first, F.greatest(F.lit(0), F.size(parts) - first + F.when(F.element_at(parts, -1) == "", 0).otherwise(1)))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _key(list_of_words: Column, at: Column, width: Column) -> Column:
    """Hash of up to three words from `at`, counted from 0."""
    return F.xxhash64(width, list_of_words[at], F.when(width > 1, list_of_words[at + 1]), F.when(width > 2, list_of_words[at + 2]))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, w array<string>) for the distinct windows of each item."""
    listed = items.where("item_id IS NOT NULL").select("item_id", words(lowered(F.col("text"))).alias("all")).where(F.size("all") > 0)
    n = F.size("all")
    return listed.select("item_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))).alias("at"), "all").select("item_id", F.slice("all", F.col("at"), F.lit(window)).alias("w")).distinct()


def _met(listed: DataFrame, side: DataFrame, widths: list[int], how: str) -> DataFrame:
    """The shingles of `widths` words of all texts, joined with a broadcast side by key; i is the place in the text."""
    keys = F.array(*[F.struct(F.lit(w).alias("width"), F.when(F.col("i") + w <= F.size("all"), _key(F.col("all"), F.col("i"), F.lit(w))).alias("key")) for w in widths])
    at = listed.select("*", F.posexplode_outer("all").alias("i", "word"))
    at = at.withColumn("key", keys[0]["key"]) if len(widths) == 1 else at.withColumn("k", F.explode(keys)).withColumn("key", F.col("k.key"))
    return at.join(F.broadcast(side), "key", how)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, row, n_words, hits array<struct<start,end,item_ids>>) for every distinct text of every doc_id.

    row is the text's xxhash64, start and end count words, end exclusive.
    """
    listed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), words(lowered(F.col("text"))).alias("all"))
    windows = checkpoint(item_windows(items, window).groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(F.xxhash64("w").alias("window_id"), "w", F.size("w").alias("n"), "item_ids"))
    width = F.least(F.col("n"), F.lit(SHINGLE))
    parts = checkpoint(windows.select("window_id", "w", "n", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("off")).select("window_id", "width", "off", _key(F.col("w"), F.col("off"), F.col("width")).alias("key")))
    shingles = checkpoint(parts.select("key", "width").distinct())
    total, widths = shingles.count(), sorted(r[0] for r in shingles.select("width").distinct().collect())
    blocks = -(-total // block_shingles)

    def block(of: DataFrame, b: int) -> DataFrame:
        return of.where(F.pmod("key", F.lit(blocks)) == b)

    def union(frames: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.union, frames)

    empty = F.array().cast(HITS)
    if not blocks:
        return listed.select("doc_id", "row", F.size("all").alias("n_words"), empty.alias("hits")).distinct()
    rarity = union([_met(listed.select("all"), block(shingles.select("key"), b), widths, "inner").groupBy("key").agg(F.count(F.lit(1)).alias("seen")) for b in range(blocks)])
    # a window one of whose shingles is nowhere seen occurs nowhere; the rarest of the others is its prefix
    ranked = parts.join(rarity, "key", "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0).cast("long")).alias("seen"), "key", "off")).alias("p"))
    prefix = checkpoint(ranked.where("p.seen > 0").join(windows, "window_id").select(F.col("p.key").alias("key"), F.col("p.off").alias("off"), "w", "n", "item_ids"))

    start = F.col("i") - F.col("off")
    same = (start >= 0) & (start + F.col("n") <= F.size("all")) & (F.slice("all", start + 1, F.col("n")) == F.col("w"))
    hit = F.when(same, F.struct(start.alias("start"), (start + F.col("n")).alias("end"), "item_ids"))
    # the first place of a text stays without a hit as well, and tells its number of words
    found = union([_met(listed, block(prefix, b), widths, "left").select("doc_id", "row", F.col("i"), F.size("all").alias("n_words"), hit.alias("hit")).where("hit IS NOT NULL OR coalesce(i, 0) = 0") for b in range(blocks)])
    return found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_words, n_hit, items array, contaminated) for every row of docs."""
    hits = occurrences(docs, items, window, block_shingles)
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h.start.alias("start"), h.end.alias("end"))))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, acc.to))).alias("n"), F.greatest(acc.to, s.end).alias("to")), lambda acc: acc.n)
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda h: h.item_ids))), lambda i: i.cast("string")))
    out = hits.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), ids.alias("items"))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    return rows.join(out, ["doc_id", "row"]).select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs, all columns kept. Rows without doc_id go."""
    hit = occurrences(docs, items).where(F.size("hits") > 0).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"))
    return rows_by(docs.where("doc_id IS NOT NULL"), {"_d": F.col("doc_id"), "_r": F.xxhash64(F.coalesce("text", F.lit("")))}, hit, "left_anti", once=False)


OP10_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, l, unnest(range(1, greatest(1, len(l) - 9) + 1)) AS i FROM b WHERE len(l) > 0),
k AS (SELECT DISTINCT item_id, l[i:i + 9] AS g FROM p),
n AS (SELECT DISTINCT len(g) AS n FROM k),
q AS (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM w, n),
h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, l[i:i + n - 1] AS g FROM q) JOIN k USING (g)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
