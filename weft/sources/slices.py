"""Random access into long sequences: a store of chunks of which only the touched folders are read.

A record is cut into chunks of `CHUNK` letters, and neighbouring chunks go to one of
`PARTS` folders. To fetch slices, the folders that hold their chunks are listed (at most
PARTS numbers reach the driver) and become a partition filter; within them rows are sorted
by record and chunk, so that row groups are skipped as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, SPAN, PARTS = 4096, 256, 256


def _part(record: Column, chunk: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(record, F.floor(chunk / SPAN)), F.lit(parts)).cast("int")


def write_store(records: DataFrame, path: str, record_id: str = "record_id", sequence: str = "sequence", chunk: int = CHUNK, parts: int = PARTS) -> None:
    """Records (record_id unique, no null) as a store; an empty sequence has no chunk. The chunk length is kept with every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                for first in range(0, len(text), chunk * SPAN):
                    own = [text[a : a + chunk] for a in range(first, min(len(text), first + chunk * SPAN), chunk)]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(first // chunk, first // chunk + n), pa.int64()), pa.array(own, pa.string()), pa.array([chunk] * n, pa.int32()), pa.array([parts] * n, pa.int32())], names=["record_id", "chunk", "letters", "chunk_length", "parts"])

    cuts = records.select(F.col(record_id).cast("string"), F.col(sequence).cast("string")).mapInArrow(cut, "record_id string, chunk long, letters string, chunk_length int, parts int")
    parted = cuts.withColumn("part", _part(F.col("record_id"), F.col("chunk"), parts))
    parted.repartition("part").sortWithinPartitions("part", "record_id", "chunk").write.mode("errorifexists").option("compression", "zstd").partitionBy("part").parquet(path)


def fetch(spark: SparkSession, path: str, intervals: DataFrame, record_id: str = "record_id", start: str = "start", end: str = "end") -> DataFrame:
    """intervals with `sequence`: the letters from `start` (from 0) up to before `end`, as far as the record has them.

    Intervals of unknown records, and those beyond a record's end, are empty; so is one with
    a null or with end <= start. Rows stay as they are, repeated ones too.
    """
    store = spark.read.parquet(path)
    kept = store.select("chunk_length", "parts").limit(1).collect()
    rows = intervals.withColumn("_row", F.struct(record_id, F.when(F.col(start).isNotNull(), F.greatest(F.lit(0), F.col(start))).cast("long").alias("a"), F.col(end).cast("long").alias("z")))
    if not kept:
        return rows.withColumn("sequence", F.lit("")).drop("_row")
    length, parts = kept[0]
    asked = rows.where(F.col("_row.z") > F.col("_row.a")).select("_row").distinct()
    # no more chunks than the record has: an end far beyond it costs nothing
    each = asked.select(F.col(f"_row.{record_id}").cast("string").alias("record_id"), F.col("_row.a").alias("a"), F.col("_row.z").alias("z"), "_row")
    spans = F.sequence(F.floor(F.col("a") / (length * SPAN)), F.floor((F.col("z") - 1) / (length * SPAN)))
    touched = each.select("record_id", F.explode(spans).alias("span")).select(_part(F.col("record_id"), F.col("span") * SPAN, parts).alias("part")).distinct()
    wanted = sorted(r.part for r in touched.collect())
    pieces = store.where(F.col("part").isin(wanted)).select("record_id", "chunk", "letters")
    at = F.col("chunk") * length
    met = pieces.join(each, "record_id").where((at < F.col("z")) & (at + length > F.col("a")))
    cut = met.select("_row", "chunk", F.expr(f"substring(letters, cast(greatest(0, a - chunk * {length}) as int) + 1, cast(least({length}, z - chunk * {length}) - greatest(0, a - chunk * {length}) as int))").alias("letters"))
    whole = cut.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "letters"))), lambda c: c.letters), "").alias("sequence"))
    return rows.join(whole, "_row", "left").withColumn("sequence", F.coalesce("sequence", F.lit(""))).drop("_row")
