"""Exact duplicates by deterministic block naming, DataFrame operations only.

Texts are equal when identical after each run of ASCII white space becomes one space
(null counts as empty). Rows that share length and a 64-bit hash with another row go
on; a row that shares them with none equals none. The rest are cut into blocks of
`block_bytes` bytes. Distinct blocks are sorted and named by their place in that
order, each document becomes a sequence of names, and adjacent pairs of names are
sorted and named in turn until one name is left. Names stand for contents one to one,
so length and last name are an identity without collisions: the hash only spares work.

Every grouping combines before its shuffle, so a group of copies of any size is one
row for each task; names return to rows by joins that Spark can split when skewed.

Edge cases: null and empty texts are equal; rows without doc_id are left out; a doc_id
that occurs twice gives a row for each occurrence, judged by its own text, and
group_size counts rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import rows_by, table, texts

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _named(values: DataFrame, *by: str) -> DataFrame:
    """Distinct values with an integer name that follows their sort order.

    The order is by the first bytes (or numbers) and a hash, so that the sample that finds
    the ranges holds no whole blocks, and by value where those are equal.
    """
    lead = [F.substring(c, 1, 16) if t == "binary" else F.col(c) for c, t in values.select(*by).dtypes] + [F.xxhash64(*by)]
    ranged = values.select(*by).distinct().repartitionByRange(*lead).sortWithinPartitions(*lead, *by)
    return checkpoint(ranged.withColumn("name", F.monotonically_increasing_id()))


def block_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n, h, name): for rows (doc_id, n, h, content binary), a name that is equal for equal contents of n bytes."""
    key = ["doc_id", "n", "h"]
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / block_bytes).cast("int") - 1)), lambda i: F.substring(F.col("content"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = checkpoint(rows.select(*key, F.posexplode(cut).alias("at", "block")))
    level = checkpoint(blocks.join(_named(blocks, "block"), "block").select(*key, "at", "name"))
    while (level.agg(F.max("at")).first()[0] or 0) > 0:
        side = lambda k: F.coalesce(F.max(F.when(F.col("at") % 2 == k, F.col("name"))), F.lit(-1).cast("long"))
        pairs = level.groupBy(*key, F.shiftright("at", 1).alias("to")).agg(side(0).alias("left"), side(1).alias("right"))
        level = checkpoint(pairs.join(_named(pairs, "left", "right"), ["left", "right"]).select(*key, F.col("to").alias("at"), "name"))
    return level.select(*key, "name").distinct()


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n, h), one row for each row of docs; n and h are length and hash of its text."""
    source = texts(docs)
    plain = source.select("doc_id", normalised(F.col("text")).alias("t"))
    keys = checkpoint(plain.select("doc_id", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"), F.sha2("t", 256).alias("text_sha256")))
    # kept apart, so that the join below has two plain sides and a crowded key can be split
    twice = checkpoint(keys.groupBy("n", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    chosen = keys.join(twice, ["n", "h"], "left_semi").select("doc_id").distinct()
    content = source.join(chosen, "doc_id", "left_semi").select("doc_id", normalised(F.col("text")).alias("t")).select("doc_id", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"), F.encode("t", "UTF-8").alias("content"))
    names = block_names(content, block_bytes)
    uses = keys.groupBy("doc_id", "n", "h").agg(F.count(F.lit(1)).alias("uses"))
    groups = checkpoint(names.join(uses, ["doc_id", "n", "h"]).groupBy("n", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("uses").alias("group_size")))
    found = names.join(groups, ["n", "name"]).select("doc_id", "n", "h", "keep_id", "group_size")
    out = keys.join(found, ["doc_id", "n", "h"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (keep == F.col("doc_id")).alias("kept"), "text_sha256", "n", "h")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n", "h")


def keep_first_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns kept; of rows that share a doc_id and a text one stays. Rows without doc_id go."""
    stay = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_d"), F.col("n").alias("_n"), F.col("h").alias("_h")).distinct()
    t = normalised(F.col("text"))
    return rows_by(docs.where("doc_id IS NOT NULL"), {"_d": F.col("doc_id"), "_n": F.octet_length(t), "_h": F.xxhash64(t)}, stay)


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
