"""Sequence expressions. Places and exchanges are made in Arrow batches, linear in the text however many sites it has."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def reverse_complement_text(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def count_of(s: Column, characters: str) -> Column:
    """How many characters of s are among `characters`."""
    return F.length(s) - F.length(F.translate(s, characters, ""))


def overlapping_count(s: Column, motif: str) -> Column:
    return F.regexp_count(s, F.lit(f"(?={re.escape(motif)})")).cast("long")


def _places(texts: pa.Array, pattern: str) -> pa.Array:
    """A list of places for each text. Texts become Python strings one at a time, places are four bytes each."""
    scan, places, ends = re.compile(pattern).finditer, array("i"), array("i", [0])
    for t in texts:
        if t.is_valid:
            places.extend(m.start() + 1 for m in scan(t.as_py()))
        ends.append(len(places))
    lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(places, np.int32) if places else np.zeros(0, np.int32)))
    return pc.if_else(texts.is_valid(), lists, pa.scalar(None, lists.type)) if texts.null_count else lists


def _found(s: Column, pattern: str) -> Column:
    """Places (from 1) where matches begin, in one scan of the text."""

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return _places(texts, pattern)

    return found(s)


def overlapping_starts(s: Column, motif: str) -> Column:
    """All places (from 1) of the motif, overlaps included."""
    return _found(s, f"(?={re.escape(motif)})")


def nonoverlapping_starts(s: Column, motif: str) -> Column:
    """Places (from 1) of the motif from left to right, each after the end of the one before."""
    return _found(s, re.escape(motif))


def strand_counts(s: Column, motifs: list[str]) -> dict[str, Column]:
    """Occurrences on either strand; a motif that is its own reverse complement counts once."""
    return {m: sum((overlapping_count(s, x) for x in sorted({m, reverse_complement_text(m)})), F.lit(0).cast("long")) for m in motifs}


def gc_fraction(s: Column) -> Column:
    """Share of G and C among A, C, G and T; null without any."""
    return F.try_divide(count_of(s, "GC"), count_of(s, "ACGT"))


def cpg_fraction(s: Column, over: str = "positions") -> Column:
    """CG pairs over length - 1 ('positions') or over A, C, G and T less one ('bases')."""
    places = F.length(s) - 1 if over == "positions" else count_of(s, "ACGT") - 1
    return F.when(places > 0, overlapping_count(s, "CG") / places)


def swapped_middle(s: Column, start: Column, motif: str) -> Column:
    """s with the two middle letters of the motif at `start` (from 1) exchanged."""
    half = len(motif) // 2
    return F.overlay(s, F.lit(motif[: half - 1] + motif[half] + motif[half - 1] + motif[half + 1 :]), start)


def mutated(s: Column, starts: Column, motif: str) -> Column:
    """The exchange made at every start, in order; one copy of the text however many there are."""
    half = len(motif) // 2
    swapped = list(motif[: half - 1] + motif[half] + motif[half - 1] + motif[half + 1 :])

    @F.pandas_udf("string")
    def exchanged(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(texts, places):
            letters = None if text is None or at is None else list(text)
            for p in at if letters else ():
                letters[p - 1 : p - 1 + len(swapped)] = swapped
            out.append(None if letters is None else "".join(letters))
        return pd.Series(out, dtype=object)

    return exchanged(s, starts)


def chunks(s: Column, size: int, n: int) -> Column:
    """n consecutive pieces of `size` characters."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(s, i * size + 1, F.lit(size)))


def kmer_counts(df: DataFrame, ident: str, sequence: str, k: int) -> DataFrame:
    """(id, code, n): canonical k-mers of each sequence as numbers (see kmer_text); windows with other letters than A, C, G, T are left out."""
    letters = np.full(256, -1, np.int64)
    letters[[ord(c) for c in "ACGT"]] = range(4)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes, counts = [], [], []
            for ident_value, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = letters[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
                n = len(code) - k + 1
                if n < 1:
                    continue
                good = np.concatenate(([0], np.cumsum(code >= 0)))
                valid = good[k:] - good[:-k] == k
                code = np.where(code < 0, 0, code)
                forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for j in range(k):
                    forward = forward * 4 + code[j : j + n]
                    back += (3 - code[j : j + n]) << (2 * j)
                got, times = np.unique(np.minimum(forward, back)[valid], return_counts=True)
                ids += [ident_value] * len(got)
                codes.append(got)
                counts.append(times)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(np.concatenate([none, *codes])), pa.array(np.concatenate([none, *counts]))], names=[ident, "code", "n"])

    kind = dict(df.dtypes)[ident]
    return df.select(ident, sequence).mapInArrow(each, f"`{ident}` {kind}, code long, n long")


def kmer_text(code: Column, k: int) -> Column:
    """The letters of a k-mer from its number, two bits a letter, the first letter highest."""
    return F.concat(*[F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - j)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for j in range(k)])


def control_windows(df: DataFrame, ident: str, sequence: str, motif: str, flank: int) -> DataFrame:
    """(id, start1) of windows as long as the motif with its number of G and C, free of other letters, other than the motif and its reverse complement, and at least `flank` away from any of their sites."""
    k, gc = len(motif), sum(c in "GC" for c in motif)
    forms = sorted({motif, reverse_complement_text(motif)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                n = len(x) - k + 1
                if n < 1:
                    continue
                sums = lambda flags: np.concatenate(([0], np.cumsum(flags)))
                strong, plain = sums(np.isin(x, [71, 67])), sums(np.isin(x, [65, 67, 71, 84]))
                site = np.zeros(n, bool)
                for f in forms:
                    site |= np.all([x[j : j + n] == ord(c) for j, c in enumerate(f)], axis=0)
                near = np.zeros(n + 1, np.int64)
                at = np.flatnonzero(site)
                np.add.at(near, np.maximum(0, at - (k - 1) - flank), 1)
                np.add.at(near, np.minimum(n, at + k + flank), -1)
                fine = (strong[k:] - strong[:-k] == gc) & (plain[k:] - plain[:-k] == k) & (np.cumsum(near[:-1]) == 0)
                got = np.flatnonzero(fine) + 1
                starts += got.tolist()
                ids += [key] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int64())], names=[ident, "start1"])

    return df.select(ident, sequence).mapInArrow(each, f"`{ident}` {dict(df.dtypes)[ident]}, start1 long")


def spaced_choice(starts: Column, width: int, seed: Column, most: int) -> Column:
    """Up to `most` of the starts, in the order of a hash, each at least `width` from those chosen before."""
    ordered = F.transform(F.array_sort(F.transform(starts, lambda s: F.struct(F.sha2(F.concat_ws("|", seed, s.cast("string")), 256).alias("h"), s.alias("s")))), lambda x: x.s)
    fits = lambda chosen, s: (F.size(chosen) < most) & ~F.exists(chosen, lambda c: F.abs(c - s) < width)
    return F.array_sort(F.aggregate(ordered, F.array().cast("array<bigint>"), lambda acc, s: F.when(fits(acc, s), F.concat(acc, F.array(s))).otherwise(acc)))
