"""Removal of repeated byte strings, by column-wise construction over aligned contexts.

Every byte covered by a string of `length` = 100 bytes that also starts earlier (in a
smaller doc_id, or before in the same document) is removed. The sorted order of all
suffixes of a corpus tells this, but inserting one symbol of each whole document a
round takes as many rounds over all files as the longest document has bytes. So the
construction is done where repeats can be, on contexts of bounded length:

1. Anchors. In each string of 100 bytes the leftmost smallest hash of 24 bytes is its
   anchor, so equal strings have equal anchors at equal places. Consecutive starts
   with one anchor are a context: its starts, and the bytes their strings cover (176
   at most). About one byte in 39 is an anchor; only hashes travel.
2. Contexts meet by anchor. One that shares its anchor with none holds no repeat. Of
   those with equal content (equal hashes of 64 bits for anchor and content) the
   earliest stays as representative and the others are repeats from end to end. Within
   a batch of documents this is settled before the shuffle.
3. Representatives that share an anchor with others fetch their bytes from their
   documents and meet again.
4. Column-wise construction. Contexts are aligned at their anchors. Each round inserts
   one symbol of every context, from the last column to the first: the order of the
   suffixes from column c follows from that of column c + 1 by a stable sort on the new
   symbols (the column of the collection's Burrows-Wheeler transform), and the common
   prefixes of neighbours from a range minimum of the old ones plus one. Where 100 or
   more bytes are shared, all but the earliest start of a run are repeats. The files
   that are read in sequence are Spark's sorted shuffle files, and a round's state is
   that of a bounded number of contexts.

An anchor with more than `group_cap` different contexts (a passage that very many
documents share has different surroundings in each) is not constructed in one task:
its strings meet, each by itself, on a hash of 128 bits, after all but the earliest of
equal ones in a batch are settled. That is exact too, and spreads over all tasks.

Edge cases: null and empty texts have no bytes; texts under 100 bytes lose nothing;
rows without doc_id are left out; a doc_id that occurs twice with one text counts once
as a source and each row gets the same result; rows that share a doc_id with different
texts are documents of their own, in the order of their texts' SHA-256; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import small_batches, table, texts
from weft.llm.packing import pack, unpack
from weft.operators.ordered import row_numbers

LENGTH, GRAM, GROUP_CAP = 100, 24, 2000
#: Bytes handled at once when anchors are found: their places have to fit 16 bits.
PIECE = 60_000
#: Contexts constructed together.
TOGETHER = 30_000
PAD = 255  # never a byte of UTF-8

_ANCHOR = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
_ANCHOR_SQL = "anchor long, content long, doc_id long, place long"
_MET = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
_MET_SQL = "anchor long, doc_id long, place long"
REPEAT, ALIGN, SINGLE = 0, 1, 2
_FETCHED = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("lead", pa.int16()), ("span", pa.int16()), ("kind", pa.int8()), ("content", pa.binary())])
_FETCHED_SQL = "g1 long, g2 long, doc_id long, at int, lead short, span short, kind byte, content binary"


def _arrays(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def _place(at: np.ndarray, lead: np.ndarray, span: np.ndarray, flag) -> np.ndarray:
    """One number that sorts by `at`, for narrow rows."""
    return at << 18 | lead << 10 | span << 2 | flag


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """at, lead, span, flag"""
    return place >> 18, place >> 10 & 255, place >> 2 & 255, place & 3


# 1. anchors


def _pieces(raw: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined, or cut with an overlap, to about PIECE bytes: bytes, and for each part its text, its place there and in the bytes."""
    held, index, inside, place, size = [], [], [], [], 0
    for i, b in enumerate(raw):
        for at in range(0, len(b) - length + 1, PIECE):
            part = b[at : at + PIECE + length - 1]
            if size and size + len(part) > PIECE + length:
                yield b"".join(held), np.array(index), np.array(inside), np.array([*place, size])
                held, index, inside, place, size = [], [], [], [], 0
            held.append(part)
            index.append(i)
            inside.append(at)
            place.append(size)
            size += len(part)
    if held:
        yield b"".join(held), np.array(index), np.array(inside), np.array([*place, size])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    ups, downs = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def _contexts(raw: list[bytes], length: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """text, at, lead, span, anchor hash, content hash of every context of the texts."""
    up, down = powers
    window, found = length - GRAM + 1, []
    for joined, index, inside, place in _pieces(raw, length):
        b = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)])))
        n = len(b) - GRAM + 1
        h = (sums[GRAM:] - sums[:n]) * down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(n, dtype=np.uint64)
        step = 1
        while 2 * step <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if window > step:
            low = np.minimum(low[: len(low) - (window - step)], low[window - step :])
        own = np.repeat(np.arange(len(index)), np.diff(place))[: len(low)]
        starts = np.flatnonzero(np.arange(len(low)) + length <= place[1:][own])
        p, part = (low[starts] & np.uint64(0xFFFF)).astype(np.int64), own[starts]
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (part[1:] != part[:-1]))))
        a, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        p, part = p[new], part[new]
        content = (sums[last + length] - sums[a]) * down[a]
        content ^= content >> np.uint64(31)
        content = content * np.uint64(0x9FB21C651E98DF25) + ((p - a) * 128 + (last - a)).astype(np.uint64)
        found.append((index[part], inside[part] + a - place[part], p - a, last - a, h[p].view(np.int64), content.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(6))


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contexts of all texts; those flagged 1 in their place equal an earlier one of their batch and are settled."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(PIECE + 3 * length)
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).to_numpy()
            text, at, lead, span, anchor, content = _contexts([t.encode("utf-8") for t in b.column("text").to_pylist()], length, powers)
            doc = ids[text]
            order = np.lexsort((at, doc, content, anchor))
            anchor, content, doc, at, lead, span = (x[order] for x in (anchor, content, doc, at, lead, span))
            same = np.zeros(len(doc), bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc)))) if len(doc) else np.zeros(0, np.int64)
            itself = same & (doc == doc[first]) & (at == at[first])  # a repeated row, not a repeat
            # settled rows need not meet others: any key that spreads them does
            anchor = np.where(same, (doc * 0x9E3779B1 + at) * 0x27D4EB2F165667C5, anchor)
            keep = ~itself
            yield _arrays(_ANCHOR, *(x[keep] for x in (anchor, content, doc, _place(at, lead, span, same))))

    return texts(docs).mapInArrow(each, _ANCHOR_SQL)


# 2. contexts that meet


def _meet(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, content, document and place: repeats, and representatives that share their anchor."""
    names = ("anchor", "content", "doc_id", "place")
    held = {n: np.zeros(0, np.int64) for n in ("anchor", "doc_id", "place")}
    last, crowded = None, None  # anchor and content of the row before, with the document and place of its class's first row; the crowded anchor being read

    def out(kind: np.ndarray, rows: dict) -> pa.RecordBatch:
        return _arrays(_MET, rows["anchor"], rows["doc_id"], rows["place"] & ~3 | kind)

    for b in batches:
        if not b.num_rows:
            continue
        r = {n: b.column(n).to_numpy() for n in names}
        done = r["place"] & 3 == 1
        if done.any():
            yield out(np.full(int(done.sum()), REPEAT), {n: r[n][done] for n in held})
            r = {n: x[~done] for n, x in r.items()}
        n = len(r["anchor"])
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (r["anchor"][1:] != r["anchor"][:-1]) | (r["content"][1:] != r["content"][:-1])
        if last is not None:
            new[0] = (r["anchor"][0], r["content"][0]) != last[:2]
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        source_doc = np.where(first < 0, last[2] if last else 0, r["doc_id"][np.maximum(first, 0)])
        source_at = np.where(first < 0, last[3] if last else 0, r["place"][np.maximum(first, 0)])
        copies = ~new & ((r["doc_id"] != source_doc) | (r["place"] != source_at))
        last = (r["anchor"][-1], r["content"][-1], source_doc[-1], source_at[-1])
        if copies.any():
            yield out(np.full(int(copies.sum()), REPEAT), {k: r[k][copies] for k in held})
        reps = {k: np.concatenate((held[k], r[k][new])) for k in held}
        if crowded is not None and len(reps["anchor"]):
            more = reps["anchor"] == crowded
            if more.any():
                yield out(np.full(int(more.sum()), SINGLE), {k: x[more] for k, x in reps.items()})
                reps = {k: x[~more] for k, x in reps.items()}
        if not len(reps["anchor"]):
            continue
        begins = np.flatnonzero(np.concatenate(([True], reps["anchor"][1:] != reps["anchor"][:-1])))
        sizes = np.diff(np.append(begins, len(reps["anchor"])))
        kind = np.repeat(np.where(sizes == 1, -1, np.where(sizes > cap, SINGLE, ALIGN)), sizes)
        if reps["anchor"][-1] == r["anchor"][-1]:  # the last group may go on in the next batch
            if sizes[-1] > cap:
                crowded = reps["anchor"][-1]
                held = {k: x[:0] for k, x in reps.items()}
            else:
                held = {k: x[begins[-1] :] for k, x in reps.items()}
                kind[begins[-1] :] = -1
        else:
            held = {k: x[:0] for k, x in reps.items()}
        sent = kind >= 0
        if sent.any():
            yield out(kind[sent], {k: x[sent] for k, x in reps.items()})
    if len(held["anchor"]) > 1:
        yield out(np.full(len(held["anchor"]), ALIGN), held)


# 3. bytes of the contexts


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, touching ones joined."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1])) if len(begin) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(end)) - 1] if len(at) else end


def _packed(begin: np.ndarray, end: np.ndarray) -> bytes:
    return pack(np.diff(np.stack([begin, end], 1).ravel(), prepend=0))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.cumsum(unpack(data)).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each document: its repeats so far (one row), contexts to align with their bytes, and single strings by hash."""
    for b in batches:
        rows: list[tuple] = []
        singles: dict[bytes, tuple[int, int]] = {}
        repeated: dict[int, list[tuple[int, int]]] = {}
        for doc_id, text, asked in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("asked"), strict=True):
            raw = text.encode("utf-8")
            anchor = asked.values.field("anchor").to_numpy()
            at, lead, span, kind = _unplace(asked.values.field("place").to_numpy())
            gone = repeated.setdefault(doc_id, [])
            whole = kind == REPEAT
            gone += zip(at[whole].tolist(), (at[whole] + span[whole] + length).tolist(), strict=True)
            for k in np.flatnonzero(kind == ALIGN).tolist():
                a, s = int(at[k]), int(span[k])
                rows.append((int(anchor[k]), 0, doc_id, a, int(lead[k]), s, ALIGN, raw[a : a + s + length]))
            for k in np.flatnonzero(kind == SINGLE).tolist():
                for s in range(int(at[k]), int(at[k]) + int(span[k]) + 1):
                    digest = xxhash.xxh3_128_digest(raw[s : s + length])
                    here, there = (doc_id, s), singles.get(digest)
                    if there is None or here < there:
                        singles[digest] = here
                        here = there
                    if here is not None and here != singles[digest]:
                        repeated.setdefault(here[0], []).append((here[1], here[1] + length))
        for digest, (doc_id, s) in singles.items():
            rows.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc_id, s, 0, 0, SINGLE, b""))
        for doc_id, gone in repeated.items():
            if gone:
                x = np.array(gone, np.int64)
                rows.append((hash((doc_id, 1)) * 0x9E3779B1 % (1 << 62), 1, doc_id, 0, 0, 0, REPEAT, _packed(*_merged(x[:, 0], x[:, 1]))))
        yield _arrays(_FETCHED, *([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(_FETCHED)))


# 4. column-wise construction


def construct(group: np.ndarray, lead: np.ndarray, contents: list[bytes], length: int) -> np.ndarray:
    """repeated[context, start]: whether the string from that column also starts in an earlier context of the group.

    Contexts are sorted by group and in their order of occurrence. Column c of the
    result is the start c - (length - GRAM) from the anchor.
    """
    n, before = len(group), length - GRAM
    width = before + length
    symbols = np.full((n, width), PAD, np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, n)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[row, within + np.repeat(before - lead, sizes)] = flat
    symbols = np.ascontiguousarray(symbols.T)

    repeated = np.zeros((before + 1, n), bool)
    order, shared = np.arange(n), np.zeros(n + 1, np.int16)  # shared[i]: bytes that suffix i has in common with the one before it
    group = group.astype(np.int64) << 8
    for c in range(width - 1, -1, -1):
        inserted = symbols[c][order]
        key = group[order] | inserted
        move = np.argsort(key, kind="stable")
        key = key[move]
        same = np.zeros(n, bool)
        same[1:] = (key[1:] == key[:-1]) & ((key[1:] & 255) != PAD)
        fresh = np.zeros(n + 1, np.int16)
        i = np.flatnonzero(same)
        u, v = move[i - 1], move[i]
        fresh[i] = shared[v]
        far = np.flatnonzero(v > u + 1)
        if len(far):
            by = np.argsort(u[far], kind="stable")
            far = far[by]
            cuts = np.stack([u[far] + 1, v[far] + 1], 1).ravel()
            fresh[i[far]] = np.minimum.reduceat(shared, cuts)[::2]
        fresh[i] += 1
        order, shared = order[move], np.minimum(fresh, length)
        if c <= before:
            begins = np.flatnonzero(shared[:n] < length)
            if len(begins) < n:
                first = np.repeat(np.minimum.reduceat(order, begins), np.diff(np.append(begins, n)))
                repeated[c][order[order != first]] = True
    return repeated.T


def _align(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeats (doc_id, spans) of rows sorted by group, document and place."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())])
    held: list[pa.RecordBatch] = []
    single = None
    before = length - GRAM

    def built(rows: pa.Table) -> pa.RecordBatch:
        # a repeated row (same document, same text) sends its contexts twice; that is no repeat
        same = np.logical_and.reduce([(x := rows.column(c).to_numpy())[1:] == x[:-1] for c in ("g1", "doc_id", "at", "lead", "span")])
        content = rows.column("content")
        for k in np.flatnonzero(same):
            same[k] = content[int(k)].equals(content[int(k) + 1])
        rows = rows.filter(pa.array(np.concatenate(([True], ~same))))
        g = rows.column("g1").to_numpy()
        group = np.concatenate(([0], np.cumsum(g[1:] != g[:-1])))
        doc, at, lead = rows.column("doc_id").to_numpy(), rows.column("at").to_numpy().astype(np.int64), rows.column("lead").to_numpy().astype(np.int64)
        mark = construct(group, lead, rows.column("content").to_pylist(), length)
        edge = np.diff(np.pad(mark, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        origin = at[row] + lead[row] - before
        begin, end = origin + begin, origin + end + length
        return by_document(doc[row], begin, end)

    def by_document(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(doc, kind="stable")
        doc, begin, end = doc[order], begin[order], end[order]
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        spans = [_packed(*_merged(b, e)) for b, e in zip(np.split(begin, at[1:]), np.split(end, at[1:]), strict=True)] if len(at) else []
        return _arrays(schema, doc[at], spans)

    for b in batches:
        kind = b.column("kind").to_numpy()
        whole = pa.array(np.flatnonzero(kind == REPEAT))
        if len(whole):
            yield _arrays(schema, b.column("doc_id").take(whole), b.column("content").take(whole))
        alone = np.flatnonzero(kind == SINGLE)
        if len(alone):
            g = np.stack([b.column(n).to_numpy()[alone] for n in ("g1", "g2")], 1)
            first = np.ones(len(alone), bool)
            first[1:] = (g[1:] != g[:-1]).any(1)
            if single is not None:
                first[0] = tuple(g[0]) != single
            single = tuple(g[-1])
            at = b.column("at").to_numpy()[alone][~first].astype(np.int64)
            yield by_document(b.column("doc_id").to_numpy()[alone][~first], at, at + length)
        aligned = np.flatnonzero(kind == ALIGN)
        if len(aligned):
            held.append(b.take(pa.array(aligned)))
            if sum(x.num_rows for x in held) >= TOGETHER:
                rows = pa.Table.from_batches(held).combine_chunks()
                g = rows.column("g1").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    yield built(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield built(pa.Table.from_batches(held).combine_chunks())


def _strip(text: str, spans: list[bytes] | None) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs, and what is left."""
    raw = text.encode("utf-8")
    if not spans:
        return len(raw), 0, 0, raw
    parts = [_unpacked(s) for s in spans]
    begin, end = _merged(np.concatenate([p[0] for p in parts]), np.minimum(np.concatenate([p[1] for p in parts]), len(raw)))
    kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))
    return len(raw), int((end - begin).sum()), len(begin), kept


def repeats(docs: DataFrame, length: int = LENGTH, group_cap: int = GROUP_CAP) -> DataFrame:
    """(doc_id, spans array<binary>) for the documents that repeat something; _strip reads the spans. A doc_id has to name one text."""
    source = texts(docs).repartition("doc_id")
    order = ["anchor", "content", "doc_id", "place"]
    met = anchors(docs, length).repartition("anchor").sortWithinPartitions(*order).mapInArrow(lambda batches: _meet(batches, group_cap), _MET_SQL)
    asked = met.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    fetched = source.join(asked, "doc_id").mapInArrow(lambda batches: _fetch(batches, length), _FETCHED_SQL)
    found = fetched.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "doc_id", "at").mapInArrow(lambda batches: _align(batches, length), "doc_id long, spans binary")
    return found.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def strip_repeats(docs: DataFrame, length: int = LENGTH, group_cap: int = GROUP_CAP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; kept is the remaining bytes, concatenated."""
    rows = texts(docs)
    own = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    if not own.where("a <> b").limit(1).count():
        return _stripped(rows, length, group_cap)
    # different texts share a doc_id: each gets a number of its own, in the same order
    row = F.sha2("text", 256).alias("row")
    numbers = row_numbers(rows.select("doc_id", row).distinct(), [], ["doc_id", "row"], "number")
    numbered = rows.select("doc_id", row, "text").join(numbers, ["doc_id", "row"]).select(F.col("number").alias("doc_id"), "text")
    back = numbers.select("number", F.col("doc_id").alias("named"))
    out = _stripped(numbered, length, group_cap).withColumnRenamed("doc_id", "number").join(back, "number")
    return out.select(F.col("named").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _stripped(docs: DataFrame, length: int, group_cap: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_strip(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts(docs).repartition("doc_id").join(repeats(docs, length, group_cap), "doc_id", "left")
    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS row, encode(coalesce(text, '')) AS b FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT doc_id, row, b FROM d),
p AS (SELECT doc_id, row, unnest(range(1, octet_length(b) - 98)) AS s, b FROM b),
k AS MATERIALIZED (SELECT doc_id, row, s, md5_number(b[s:s + 99]) AS k FROM p),
f AS (SELECT k, min((doc_id, row, s)) AS first FROM k GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, row, s, (doc_id, row, s) <> first AS again FROM k JOIN f USING (k)),
i AS (SELECT doc_id, row, s, s + 100 AS e, max(s + 100) OVER (PARTITION BY doc_id, row ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE again),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM i),
u AS (SELECT doc_id, row, run, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, row, run),
t AS (SELECT doc_id, row, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM u GROUP BY doc_id, row),
x AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, coalesce(list_prepend(1, es), [1]) AS froms, coalesce(list_append(ss, octet_length(b) + 1), [octet_length(b) + 1]) AS tos FROM d LEFT JOIN t USING (doc_id, row))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda k: substr(h, 2 * froms[k] - 1, 2 * (tos[k] - froms[k]))), ''))) AS kept_sha256 FROM x
"""
