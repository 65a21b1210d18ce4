"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words whose smallest period is q, at least `LEAST` words and
`REPEATS` periods long, that no neighbouring word extends keeping the period. For every
period p the words at the grid points jp and (j+1)p are compared: a stretch of three
periods holds words that equal the one p further on for 2p places or more, so at least
two grid points in a row must agree, and every run is met. All grids of a text of n words
together have n (1 + 1/2 + 1/3 + ...) points, compared as arrays. Survivors are extended
to both sides by comparing chunks of doubling length. Grid points within a run that was
found with a divisor of p are skipped, as the stretch around them is that run; periods go
up, so a stretch is met first with its smallest period.

A text is one row and is searched in one task (a grid costs n log n, words are numbers of
four bytes there); texts are read in one pass and nothing is shuffled.

Edge cases: words are maximal stretches without ASCII white space; null, empty and blank
texts have no words and no runs; rows without doc_id are left out; repeated rows are
searched each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import small_batches, table, texts

LEAST, REPEATS, CHUNK = 24, 3, 32
#: The grids of texts of up to so many words are kept as arrays (20 bytes for each of n log n points); longer texts go grid by grid.
GRID_WORDS = 1 << 16


def _first_false(same: Callable[[int, int], np.ndarray], length: int) -> int:
    """How many places hold from the first on; same(i, j) compares the places i to j, in chunks of doubling length."""
    at, step = 0, CHUNK
    while at < length:
        end = min(length, at + step)
        part = same(at, end)
        if not part.all():
            return at + int(np.argmin(part))
        at, step = end, step * 2
    return length


def _stretch(w: np.ndarray, p: int, x: int) -> tuple[int, int]:
    """The first and the last but one of the places around x that equal the one p further on."""
    right = _first_false(lambda i, j: w[x + i : x + j] == w[x + p + i : x + p + j], len(w) - p - x)
    left = _first_false(lambda i, j: (w[x - j : x - i] == w[x - j + p : x - i + p])[::-1], x)
    return x - left, x + right


def _grids(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points x = jp of all periods p of texts of up to n words: x, p and x + 2p, by the last."""
    period = np.repeat(np.arange(1, n // 2 + 1), [max(0, (n - 1) // p - 1) for p in range(1, n // 2 + 1)])
    first = np.flatnonzero(np.diff(period, prepend=0))
    point = (np.arange(len(period)) - np.repeat(first, np.diff(first, append=len(period)))) * period
    order = np.argsort(point + 2 * period, kind="stable")
    return tuple(a[order].astype(np.int32) for a in (point, period, point + 2 * period))


def _survivors(w: np.ndarray, grids: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Periods, ascending, and the grid points at which two words in a row equal the ones a period further on."""
    n = len(w)
    if n > GRID_WORDS:  # one grid at a time
        for p in range(1, n // REPEATS + 1):
            agree = w[:-p:p] == w[p::p]
            points = np.flatnonzero(agree[:-1] & agree[1:])
            if len(points):
                yield p, points * p
        return
    size = 1 << (n - 1).bit_length()
    if size not in grids:
        grids[size] = _grids(size)
    point, period, reach = grids[size]
    m = np.searchsorted(reach, n)
    point, period = point[:m], period[:m]
    agree = np.flatnonzero(w[point] == w[point + period])
    point, period = point[agree], period[agree]
    agree = (w[point + period] == w[point + 2 * period]) & (period <= n // REPEATS)
    agree[agree] &= w[(point + period // 2)[agree]] == w[(point + period // 2 + period)[agree]]
    point, period = point[agree], period[agree]
    order = np.lexsort((point, period))
    point, period = point[order], period[order]
    cuts = np.flatnonzero(np.diff(period)) + 1
    for part in np.split(np.arange(len(period)), cuts) if len(period) else []:
        yield int(period[part[0]]), point[part].astype(np.int64)


def find_runs(w: np.ndarray, grids: dict | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period. `grids` keeps the grids from text to text."""
    n, found = len(w), []
    longest: list[tuple[int, int, int, int]] = []  # (-length, start, end, period), longest first
    for p, points in _survivors(w, {} if grids is None else grids) if n >= LEAST else ():
        held = []
        for minus, start, end, q in longest:
            if -minus <= 2 * p:
                break
            if p % q == 0:
                held.append((start, end - p))
        if held:
            held.sort()
            starts, ends = np.array(held).T
            k = np.searchsorted(starts, points, "right") - 1
            points = points[(k < 0) | (points >= ends[k])]
        if len(points) > 3:  # all words up to the next grid point must agree: the first of them at all points together
            upto = np.arange(1, min(p, CHUNK))
            ahead = points[:, None] + upto
            points = points[(w[ahead] == w[ahead + p]).all(1)]
        done = -1
        for x in points.tolist():
            if x < done:
                continue
            first, done = _stretch(w, p, x)
            end = done + p
            if end - first >= max(LEAST, REPEATS * p):
                found.append((first, end - first, p))
                insort(longest, (first - end, first, end, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if every run keeps its first period alone."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _searched(docs: DataFrame, schema: str, finish) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict = {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.encode("utf-8").split()  # bytes split at ASCII white space alone
                numbers: dict[bytes, int] = defaultdict(count().__next__)
                rows.append((doc_id, *finish(words, find_runs(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), grids))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = {"long": pa.int64(), "string": pa.string(), "array<struct<start:long,length:long,period:long>>": pa.list_(run)}
    out = pa.schema([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in schema.split("; ")])
    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(each, schema.replace("; ", ", "))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period)), runs by start, then period."""
    return _searched(docs, "doc_id long; n_words long; runs array<struct<start:long,length:long,period:long>>", lambda words, runs: (len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]))


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text): as periodic_runs, and the words that stay if every run keeps its first period alone, joined by spaces."""

    def finish(words, runs):
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], _joined(words, runs).decode("utf-8")

    return _searched(docs, "doc_id long; n_words long; runs array<struct<start:long,length:long,period:long>>; text string", finish)


def _joined(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    return b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words)


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli of the run of most periods, runs_sha256, collapsed_sha256).

    Of equal exponents the smallest start, then the smallest period; fractions are compared exactly.
    """

    def finish(words, runs):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        most = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
        return len(runs), *most, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(_joined(words, runs))

    return _searched(docs, "doc_id long; n_runs long; start long; length long; period long; exponent_milli long; runs_sha256 string; collapsed_sha256 string", finish)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, by hash of doc_id, repeat a stretch of their words to the end.

    With h = crc32 of doc_id as text, g = h div 10 and n words: if h mod 10 is 0, word i from
    a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = texts(docs).withColumns({"_h": h, "_w": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0))})
    sized = rows.withColumns({"_n": F.size("_w"), "_g": F.floor(F.col("_h") / 10)})
    cut = sized.withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    part = cut.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    again = F.expr("array_join(concat(slice(_w, 1, _a), slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast((_n - _a + _p - 1) div _p as int))), 1, _n - _a)), ' ')")
    return part.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, a tenth of the documents with a planted period."""
    return summary(with_periods(table(spark, sf_dir, "documents")))
