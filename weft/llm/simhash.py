"""SimHash near-duplicate groups, with pigeonring filtering of candidate pairs.

Fingerprints: text with A-Z lower-cased, words are runs of other than ASCII white
space, shingles of `width` words joined by a space (repeats count; fewer words make
one shingle; no word makes fingerprint zero). A bit is 1 if it is set in over half of
the shingles' XXH64 (seed 42).

Linking: fingerprints that differ in at most `distance` = 2 bits. The 64 bits lie on a
ring of five segments. If two fingerprints differ in at most 2 bits, some segment
starts a chain in which, for every length l, the first l segments together differ in
at most floor(2 l / 5) bits (the pigeonring principle): the first two are equal, three
or four differ in at most one, all five in at most two. So rows meet on two equal
consecutive segments (25 or 26 bits), chains of three and four are held to their
budgets, and only then is the full distance taken.

Only distinct fingerprints are joined, so copies of a text cost nothing. A bucket of
more than `bucket_cap` fingerprints is not expanded into pairs: its members meet on
their one-bit variants instead (two fingerprints are within two bits exactly if they
share a variant), which is linear in the bucket and loses no link.

Edge cases: null and empty texts share fingerprint zero and are linked like any other;
rows without doc_id are left out; a doc_id that occurs twice gives one row for each
occurrence; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import small_batches, table, texts
from weft.operators.graph import components

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 2
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: str, width: int) -> list[int]:
    words = text.encode("utf-8").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of `sizes` hashes. Eight byte lanes are added at once, in runs of at most 255."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    pieces = (n + 254) // 255
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    cuts = np.repeat(starts - first * 255, pieces) + np.arange(pieces.sum()) * 255
    fingerprint = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for lane in range(8):  # little-endian: lane k holds bit 8k + bit
            fingerprint |= (counts[:, lane] * 2 > n).astype(np.uint64) << np.uint64(8 * lane + bit)
    out[full] = fingerprint
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; the fingerprint's bits are those of the long."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_hashes(x or "", width) for x in b.column("text").to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((h for x in found for h in x), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(_majority(flat, sizes).view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(each, "doc_id long, fp long")


def _ring_mask(start: int, length: int) -> int:
    m = 0
    for k in range(start, start + length):
        at, width = SEGMENTS[k % len(SEGMENTS)]
        m |= ((1 << width) - 1) << at
    return m - (1 << 64) if m >> 63 else m


def _by_start(column: Column, length: int) -> Column:
    """`column`, a start 0..4, turned into the mask of the chain of `length` segments from there."""
    return F.element_at(F.array(*[F.lit(_ring_mask(i, length)).cast("long") for i in range(len(SEGMENTS))]), column + 1)


def links(distinct: DataFrame, bucket_cap: int = 200) -> DataFrame:
    """Edges (u, v) between rows (fp, rep) of distinct fingerprints within two bits; u and v are reps.

    Small buckets give their pairs; larger ones give stars that join the same members.
    """
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_ring_mask(i, 2))).alias("key")) for i in range(len(SEGMENTS))])).alias("s")
    rows = distinct.select("fp", "rep", starts).select("fp", "rep", "s.start", "s.key")
    sizes = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpoint(rows.join(sizes, ["start", "key"]))
    light, heavy = met.where(F.col("n") <= bucket_cap), met.where(F.col("n") > bucket_cap)

    a, b = light.select("start", "key", F.col("fp").alias("fa"), F.col("rep").alias("u")), light.select("start", "key", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    within = lambda length: F.bit_count(differ.bitwiseAND(_by_start(F.col("start"), length))) <= length * DISTANCE // len(SEGMENTS)
    pairs = a.join(b, ["start", "key"]).where((F.col("fa") < F.col("fb")) & within(3) & within(4)).where(F.bit_count(differ) <= DISTANCE).select("u", "v")

    outside = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)), lambda bit: bit.bitwiseAND(_by_start(F.col("start"), 2)) == 0)
    variants = heavy.select("start", "rep", F.explode(F.concat(F.array("fp"), F.transform(outside, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("variant"))
    hubs = variants.groupBy("start", "variant").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    stars = variants.join(hubs, ["start", "variant"]).where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    return pairs.union(stars).distinct()


def near_groups(docs: DataFrame, width: int = 3, bucket_cap: int = 200) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    prints = checkpoint(fingerprints(docs, width))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(distinct, bucket_cap))
    of_print = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
