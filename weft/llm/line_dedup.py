"""Line dedup over the whole corpus, returning compressed keep bitmaps.

Lines are the parts of a text between newlines. A line's key is the line without ASCII
white space at both ends and with A-Z lower-cased. Keys of at least `least_length` =
20 code points found in at least `least_docs` = 3 documents lose all their lines,
except those in the largest doc_id that holds the key.

Each text gives one row for each of its distinct keys: a 128-bit hash, the doc_id, a
hash of the text, and the places of its lines. Rows are range-partitioned by hash and document, and
sorted within a partition by hash, then document (largest first), then place. A
partition is streamed with a constant amount of state: the first row of a key is the
document that keeps it, the next wait until enough documents are seen, later ones are
dropped at once. As the range also splits on the document, a key in a third of all
rows spreads over many partitions; the first and last key of each partition may go on
in another, so what they leave open is settled apart, by a grouped sum and maximum
(combined before the shuffle) joined back.

Edge cases: null or empty text is one empty line, which is kept; rows without doc_id
are left out; rows that share a doc_id count as one document, and each of them loses
its own lines with the keys that the document loses; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import small_batches, table, texts

BLANK = " \t\n\x0b\x0c\r"
LEAST_LENGTH, LEAST_DOCS = 20, 3
_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int32()), ("places", pa.list_(pa.int32()))])
_KEYS_SQL = "h1 long, h2 long, doc_id long, row long, n_lines int, places array<int>"
_STREAMED = _KEYS.append(pa.field("docs", pa.int64())).append(pa.field("open", pa.bool_()))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): with its doc_id, row tells a text from others that share the id."""
    return texts(docs).withColumn("row", F.xxhash64("text"))


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(h1, h2, doc_id, row, n_lines, places) for every distinct long line key of every text."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, found, sizes, places = [], [], [], []
            for text in b.column("text").to_pylist():
                seen: dict[bytes, list[int]] = {}
                lines = text.split("\n")
                for place, line in enumerate(lines):
                    key = line.strip(BLANK)
                    if len(key) >= least_length:
                        seen.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8").lower()), []).append(place)
                digests += seen
                places += seen.values()
                found.append(len(seen))
                sizes.append(len(lines))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = np.repeat(np.arange(b.num_rows), found)
            cols = (h[:, 0], h[:, 1], b.column("doc_id").cast(pa.int64()).take(pa.array(own)), b.column("row").take(pa.array(own)), np.array(sizes, np.int32)[own], places)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(cols, _KEYS, strict=True)], schema=_KEYS)

    return _rows(docs).mapInArrow(each, _KEYS_SQL)


def _stream(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows to drop from one sorted partition (open false), and what other partitions may have to say (open true).

    A key that begins here has its largest document first. Rows of the partition's first
    key are all open, as it may have begun before. Of its last key, rows that wait for
    more documents are open; if it has enough, one row without places passes its count on.
    `docs` is 1 in the first row of each document, the count in a passed-on row, else 0.
    """
    key, doc, top, seen, first = None, None, None, 0, False
    waiting: list[pa.RecordBatch] = []  # of the last key, with docs and open

    def marked(rows: pa.RecordBatch, docs: np.ndarray, is_open: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns[: len(_KEYS)], pa.array(docs, pa.int64()), pa.array(np.full(rows.num_rows, is_open))], schema=_STREAMED)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h1, h2, d = (b.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        new_key, new_doc = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_key[0] = key != (h1[0], h2[0])
        new_doc[1:] = new_key[1:] | (d[1:] != d[:-1])
        new_doc[0] = new_key[0] or d[0] != doc
        begins = np.flatnonzero(np.concatenate(([True], new_key[1:])))
        sizes = np.diff(np.append(begins, n))
        docs = np.add.reduceat(new_doc.astype(np.int64), begins)
        tops = d[begins].copy()
        opening = np.zeros(len(begins), bool)
        if new_key[0]:
            opening[0], waiting = key is None, []
        else:
            docs[0] += seen
            tops[0], opening[0] = top, first
        enough = (docs >= least_docs) & ~opening
        if enough[0]:
            for w in waiting:
                gone = w.column("doc_id").to_numpy() != tops[0]
                yield marked(w.filter(pa.array(gone)), np.zeros(int(gone.sum()), np.int64), False)
            waiting = []
        of_first = np.flatnonzero(np.repeat(opening, sizes))
        if len(of_first):
            yield marked(b.take(pa.array(of_first)), new_doc[of_first].astype(np.int64), True)
        gone = np.flatnonzero(np.repeat(enough, sizes) & (d != np.repeat(tops, sizes)))
        if len(gone):
            yield marked(b.take(pa.array(gone)), np.zeros(len(gone), np.int64), False)
        if len(begins) > 1:
            waiting = []
        if not enough[-1] and not opening[-1]:
            waiting.append(marked(b.slice(begins[-1]), new_doc[begins[-1] :].astype(np.int64), True))
        key, doc, top, seen, first = (h1[-1], h2[-1]), d[-1], tops[-1], int(docs[-1]), bool(opening[-1])
    yield from waiting
    if key is not None and not first and seen >= least_docs:
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*key, top, 0, 0, [], seen, True), _STREAMED, strict=True)], schema=_STREAMED)


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, keep) for the texts that lose lines; row is the text's xxhash64.

    keep is a zlib-compressed bitmap of the text's lines, first line in the lowest bit.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    streamed = checkpoint(line_keys(docs, least_length).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _stream(batches, least_docs), _KEYS_SQL + ", docs long, open boolean"))
    still = streamed.where("open")
    totals = checkpoint(still.groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("doc_id").alias("top")).where(F.col("total") >= least_docs))
    settled = still.join(totals, ["h1", "h2"]).where("doc_id <> top")
    lost = ["doc_id", "row", "n_lines", "places"]
    drops = streamed.where("NOT open").select(*lost).union(settled.select(*lost))
    by_text = drops.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("dropped"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, counts = [], []
            for n, dropped in zip(b.column("n_lines").to_pylist(), b.column("dropped").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[dropped] = False
                packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
                counts.append(n - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("n_lines").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "row", "n_lines", "n_dropped", "keep"])

    return by_text.mapInArrow(pack, "doc_id long, row long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): every text without the lines that its bitmap drops."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, dropped, kept = [], [], []
            for text, packed in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), strict=True):
                lines = text.split("\n")
                stay = lines
                if packed is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little", count=len(lines))
                    stay = [x for x, k in zip(lines, keep.tolist(), strict=True) if k]
                sizes.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    joined = _rows(docs).join(bitmaps.select("doc_id", "row", "keep"), ["doc_id", "row"], "left").drop("row")
    return joined.mapInArrow(each, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS lost FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
