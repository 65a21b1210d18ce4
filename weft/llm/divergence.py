"""Source divergence audit over deduplicated count columns.

For each language the terms that at least `least_docs` of its documents hold are kept.
Every source of the language gives each kept term a smoothed share in parts of 10^9, and
so does the language as a whole. Two sources differ by the sum over all kept terms of the
absolute difference of their shares; a source stands out by the terms it holds more often
than its language does.

Most terms are rare and many have the same sparse vector of counts over the sources, so
terms are grouped by that vector, each pair of sources is evaluated once for each distinct
vector, and the result is multiplied by the number of terms that have it. Sources are
numbered and taken in blocks of `BLOCK`: a task gets the distinct vectors cut to two
blocks, which are grouped again, and adds up a small matrix of exact integers; the salts
that share out a language's vectors follow their number. Ranked terms are the original
ones.

Words are counted by the batch in Arrow, so what is shuffled is terms, not words, and a
hot source or language is added up before the shuffle and then spread over its terms. No
table of terms, sources or vectors is broadcast or collected.

Edge cases: null text, lang and source count as empty strings; a source without kept terms
has shares of one kind and is compared like any other; a language without kept terms has
pairs of value 0; a language with one source has no pair; rows without doc_id count, as
every row is a document; repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import small_batches, table

LEAST_DOCS, TOP, SCALE, ADDED = 30, 50, 1_000_000_000, 5
BLOCK, VECTORS_EACH, TEXT_CHARS = 128, 1024, 16_000_000
#: Fixed value: what a term is.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it), one row for each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lower = re.compile(TERM).findall, str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

        def counted(groups: list[tuple[str, str]], found: list[list[str]]) -> pa.RecordBatch:
            terms: dict[str, int] = defaultdict(count().__next__)
            names: dict[tuple[str, str], int] = defaultdict(count().__next__)
            word = np.fromiter((terms[t] for f in found for t in f), np.int64, sum(map(len, found)))
            doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
            group = np.fromiter(map(names.__getitem__, groups), np.int64, len(groups))
            pair, n = np.unique(doc * len(terms) + word, return_counts=True)
            place, at = np.unique(group[pair // max(1, len(terms))] * len(terms) + pair % max(1, len(terms)), return_inverse=True)
            total, docs_ = np.zeros(len(place), np.int64), np.bincount(at, minlength=len(place))
            np.add.at(total, at, n)
            own, all_names = pa.array(list(terms), pa.string()), list(names)
            g = place // max(1, len(terms))
            cols = [pa.array([x[k] for x in all_names], pa.string()).take(pa.array(g)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*cols, own.take(pa.array(place % max(1, len(terms)))), pa.array(total), pa.array(docs_.astype(np.int64))], schema=_COUNTED)

        groups, found, chars = [], [], 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                groups.append((lang, source))
                found.append(find(text.translate(lower) if not text.isascii() else text.lower()))
                chars += len(text)
                if chars >= TEXT_CHARS:
                    yield counted(groups, found)
                    groups, found, chars = [], [], 0
        if found:
            yield counted(groups, found)

    small_batches(docs.sparkSession)
    sums = [F.sum(c).alias(c) for c in ("n", "docs")]
    return _named(docs, "lang", "source", "text").mapInArrow(each, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(*sums)


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE (n + ADDED) / (total + ADDED kept)), exact for any long."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + F.lit(ADDED).cast("decimal(1,0)")).cast("decimal(20,0)")
    under = (whole(total) + F.lit(ADDED).cast("decimal(1,0)") * whole(kept)).cast("decimal(22,0)")
    return 1 + F.call_function("div", over, under)


def _shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The same for arrays of longs: as Python integers where a product could pass 2^63."""
    if n.max(initial=0) + ADDED < 9_000_000_000:
        return 1 + SCALE * (n + ADDED) // (total + ADDED * kept)
    return (1 + SCALE * (n.astype(object) + ADDED) // (total.astype(object) + ADDED * kept)).astype(np.int64)


def _pair_sums(key: tuple, sources: pa.Table, vectors: pa.Table) -> pa.Table:
    """For a language's two blocks and one salt: the sums of differences of all pairs between the blocks (within, if it is one)."""
    lang, one, two, _ = (k.as_py() for k in key)
    number = sources.column("number").to_numpy()
    order = np.argsort(number)
    number, total = number[order], sources.column("total").to_numpy()[order]
    kept = sources.column("kept")[0].as_py()
    out = np.zeros((len(number), len(number)), np.int64)
    terms = vectors.column("terms").to_numpy() if vectors.num_rows else np.zeros(0, np.int64)
    bounds = vectors.column("entries").combine_chunks().offsets.to_numpy() if vectors.num_rows else np.zeros(1, np.int64)
    flat = vectors.column("entries").combine_chunks().values if vectors.num_rows else None
    step = max(1, 4_000_000 // max(1, len(number)))
    for a in range(0, len(terms), step):
        b = min(len(terms), a + step)
        counts = np.zeros((len(number), b - a), np.int64)
        part = flat.slice(int(bounds[a]), int(bounds[b] - bounds[a]))
        row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        counts[np.searchsorted(number, part.field("number").to_numpy()), row] = part.field("n").to_numpy()
        p = _shares(counts, total[:, None], kept)
        for i in range(len(number)):
            out[i] += np.abs(p - p[i]) @ terms[a:b]
    left, right = np.nonzero((number[:, None] // BLOCK == one) & (number[None, :] // BLOCK == two) & (number[:, None] < number[None, :]))
    n = len(left)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "u": pa.array(number[left], pa.int64()), "v": pa.array(number[right], pa.int64()), "value": pa.array(out[left, right], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, q, value, rank): part `pair` the other sources by difference, part `term` the `top` terms that stand out; q is the item's or the language's share in `term`, null in `pair`."""
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("entries")).where(F.col("docs") >= least_docs).drop("docs")
    kept = checkpoint(kept)  # one row a term; a row holds at most one entry for each source
    entry = kept.select("lang", "term", "all_n", F.explode("entries").alias("e")).select("lang", "term", "all_n", "e.source", "e.n")
    groups = _named(docs, "lang", "source").distinct()
    totals = entry.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", number.alias("number"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")])
    sources = checkpoint(sources)
    return _pairs(sources, kept, entry).unionByName(_terms(sources, entry, top))


def _pairs(sources: DataFrame, kept: DataFrame, entry: DataFrame) -> DataFrame:
    numbered = entry.join(sources.select("lang", "source", "number"), ["lang", "source"])
    columns = numbered.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("entries"))
    vectors = columns.groupBy("lang", "entries").agg(F.count(F.lit(1)).alias("terms"))
    blocks = sources.groupBy("lang").agg((F.floor(F.max("number") / BLOCK) + 1).alias("blocks"), F.max("kept").alias("most"))
    # a language has at most `kept` distinct vectors
    blocks = blocks.withColumn("salts", (F.floor(F.col("most") / VECTORS_EACH) + 1).cast("long"))
    both = F.expr("explode(filter(flatten(transform(sequence(0L, blocks - 1), i -> transform(sequence(0L, blocks - 1), j -> struct(i as one, j as two)))), x -> x.one <= x.two))")
    cells = blocks.select("lang", "salts", both.alias("cell")).select("lang", "salts", "cell.*")
    cut = vectors.join(cells, "lang").select("lang", "one", "two", F.expr(f"filter(entries, e -> e.number div {BLOCK} in (one, two))").alias("entries"), "terms", "salts")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("entries"), F.col("salts"))).groupBy("lang", "one", "two", "salt", "entries").agg(F.sum("terms").alias("terms"))
    own = sources.withColumn("block", F.floor(F.col("number") / BLOCK)).join(cells, "lang").where(F.col("block").isin(F.col("one"), F.col("two")))
    # new names for the columns that both sides take from the cells
    own = own.select(*[F.col(c).alias(c) for c in ("lang", "one", "two")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("number").cast("long").alias("number"), "total", "kept")
    cut = cut.select("lang", "one", "two", F.col("salt").cast("long").alias("salt"), F.transform("entries", lambda e: F.struct(e.number.cast("long").alias("number"), e.n.alias("n"))).alias("entries"), "terms")
    key = ["lang", "one", "two", "salt"]
    sums = own.groupBy(*key).cogroup(cut.groupBy(*key)).applyInArrow(_pair_sums, "lang string, u long, v long, value long").groupBy("lang", "u", "v").agg(F.sum("value").alias("value"))
    ends = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("lang", "value", "e.*")
    name = lambda at, to: sources.select("lang", F.col("number").cast("long").alias(at), F.col("source").alias(to))
    named = ends.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    return _ranked(named.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(None).cast("long").alias("q"), "value"), None)


def _terms(sources: DataFrame, entry: DataFrame, top: int) -> DataFrame:
    given = entry.join(sources.drop("number"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "total", "kept").alias("p"), share("all_n", "lang_total", "kept").alias("q"))
    return _ranked(given.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", "q", (F.col("p") - F.col("q")).alias("value")), top)


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
held AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
sized AS (SELECT lang, count(*) AS v FROM held GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN held USING (lang, term) GROUP BY ALL),
sources AS (
  SELECT d.lang, d.source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN counts c ON c.lang = d.lang AND c.source = d.source GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, h.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM sources s JOIN sized USING (lang) JOIN held h ON h.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = h.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(all_n) + 5 * any_value(v)) AS q
  FROM counts JOIN (SELECT lang, sum(n) AS all_n FROM counts GROUP BY lang) USING (lang) JOIN sized USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
