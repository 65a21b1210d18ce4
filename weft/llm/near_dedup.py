"""Near-duplicate groups on five-word shingles: SimHash words on a ring of segments, then the exact similarity.

Sets: words as in simhash (A-Z lower-cased, runs of other than ASCII white space),
shingles of `WIDTH` = 5 words, fewer words make one shingle, no word makes one shingle of
its own. A set holds the distinct XXH64 (seed 42) of its shingles. Two documents are
linked if 9 shared >= 4 (n + m), which is a Jaccard similarity of 0.8 or more; a group is
a connected component.

One fingerprint of 64 bits cannot find such pairs: at 0.8 its expected distance is 10
bits, far beyond what segments of it can be joined on. So the ring is laid over the
shingles. Their hash range is cut into segments, about three shingles in each, and a
segment's word is the SimHash of its shingles. Linked sets differ in at most
k = (n + m) / 9 <= n / 4 shingles, and a shingle lies in one segment, so at most k words of
a document are missing from the other: among its first k + 1 words, in any order common to
all documents, one is shared (the pigeonhole on segments, with a budget of zero for the
first link of a chain). The longer links follow before any set travels: two linked sets
differ in d <= (n + m) / 9 shingles, so on a ring of M segments some start has, for every
length l, at most floor(l d / M) differences in its first l segments (the pigeonring
principle; a differing word stands for one difference at least). Pairs that met are held
to that for chains of 1, 2, 4, ... segments and the whole ring, on a byte of each word,
and only then is the exact similarity taken. Words of many shingles come first in that order. As only equal
contents have equal words, a passage that many documents share rarely makes a key, while
copies meet on many. Documents whose shingles fall into too few segments meet on n // 5 + 1
plain shingles as well. Segments are sized by classes of document sizes; a document that
could have a partner in the next class takes part there too. Every linked pair meets.

Documents that meet on a key of at most `CROWD` documents are compared each with each.
A larger crowd is as good as always a group of near copies. Its hub, the member that is in
most crowds, is the one that the others were made from or the nearest to it, and crowds of
one hub are one cluster. All of a cluster's members are compared with the hub. The largest
component that this leaves in the cluster needs no more comparisons within itself; all
other members (the rest) are compared with all members, in blocks: a task counts the
shingles shared by two blocks as a product of matrices and emits a spanning forest of the
links, not the pairs. Blocks are made by size, and sizes too far apart don't meet. So no
link between two components is missed, what is written grows with documents times
blocks, and the comparisons with the rest of a crowd times the crowd.

Edge cases: null and empty texts are equal to each other; rows without doc_id are left
out; rows that share a doc_id are nodes of their own if their texts differ; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import rows_by, small_batches
from weft.operators.graph import components
from weft.llm.simhash import _hashes, _majority

WIDTH, CROWD = 5, 64
#: A block of a cluster: rows and hashes at most (a longer set is a block of its own), and salts for the rows of one cluster.
BLOCK_ROWS, BLOCK_HASHES, SALTS = 2048, 1 << 20, 32
#: Of the left block so many rows, and of hashes shared so many columns, are at work at once.
SLICE_ROWS, SLICE_COLUMNS = 256, 1024
#: Size classes: each begins at 1.5 times the one before. A class has 0.35 segments for each shingle of its largest sets.
_FIRST = [1]
while _FIRST[-1] < 1 << 40:
    _FIRST.append(max(_FIRST[-1] + 1, -(-_FIRST[-1] * 3 // 2)))
_FIRST = np.array(_FIRST, np.int64)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bits of the filter that spares documents without candidates a second look.
_PLACES = 1 << 22


def _set(text: str | None) -> np.ndarray:
    return np.unique(np.array(_hashes(text or "", WIDTH) or [0], np.uint64))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p, m in zip(parts, _MIX, strict=False):
        h = (h ^ p.astype(np.uint64)) * m
        h ^= h >> np.uint64(29)
    return h


def _simhash(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each run of `counts` hashes; runs of up to four by bit operations, as most are that short."""
    out = np.zeros(len(begins), np.uint64)
    for n in (1, 2, 3, 4):
        at = np.flatnonzero(counts == n)
        a, b, c, d = (flat[begins[at] + min(j, n - 1)] for j in range(4))
        out[at] = a if n == 1 else a & b if n == 2 else (a & b) | (c & (a | b)) if n == 3 else (a & b & (c | d)) | (c & d & (a | b))
    at = np.flatnonzero(counts > 4)
    if len(at):
        n = counts[at]
        out[at] = _majority(flat[np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], n)
    return out


def _segments(size_class: np.ndarray) -> np.ndarray:
    return np.maximum(1, _FIRST[size_class + 1] * 35 // 100)


def _ring(flat: np.ndarray, sizes: np.ndarray, size_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the set, segment, word, shingles) of the segments that hold shingles, by set and segment."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    ring = _segments(size_class).astype(np.uint64)[of]
    segment = ((flat >> np.uint64(32)) * ring) >> np.uint64(32)  # rises with the hash, and hashes are sorted
    begins = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (segment[1:] != segment[:-1]))))
    counts = np.diff(np.append(begins, len(flat)))
    of = of[begins]
    return of, segment[begins], _mixed(_simhash(flat, begins, counts), segment[begins], size_class[of]), counts


def _words(flat: np.ndarray, sizes: np.ndarray, size_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k + 1 words of each set (its place, the word), and which sets have fewer words than that."""
    of, _, word, counts = _ring(flat, sizes, size_class)
    order = np.lexsort((word, -np.minimum(counts, 4), of))
    of, word = of[order], word[order]
    found = np.bincount(of, minlength=len(sizes))
    place = np.arange(len(of)) - np.repeat(np.cumsum(found) - found, found)
    first = place <= sizes[of] // 4
    return of[first], word[first], found <= sizes // 4


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, key) for all keys of a batch of sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    own = np.searchsorted(_FIRST, sizes, "right") - 1
    of, word, sparse = _words(flat, sizes, own)
    out = [(of, word)]
    also = np.flatnonzero(sizes * 5 // 4 >= _FIRST[own + 1])
    if len(also):
        of, word, few = _words(np.concatenate([sets[i] for i in also]), sizes[also], own[also] + 1)
        sparse[also] |= few
        out.append((also[of], word))
    for i in np.flatnonzero(sparse):
        plain = sets[i][: sizes[i] // 5 + 1]
        out.append((np.full(len(plain), i), _mixed(plain)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(docs: DataFrame) -> DataFrame:
    """(node, text): a node stands for the rows that share doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id", text).alias("node"), text.alias("text"))


def keys(docs: DataFrame) -> DataFrame:
    """(key, node): linked documents share a key."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of, key = _keys([_set(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("node").take(pa.array(of))], names=["key", "node"])

    return _texts(docs).mapInArrow(each, "key long, node long")


def _of_asked(docs: DataFrame, asked: DataFrame, columns: Callable[[list[np.ndarray]], list[pa.Array]], names: list[str], schema: str) -> DataFrame:
    """node and `columns` of the sets of the documents that a filter of fixed size (half a megabyte) lets pass: all of `asked`, few others. A repeated row comes again."""
    at = F.pmod("node", F.lit(_PLACES)) + 1
    maps = asked.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    places = np.zeros((_PLACES // 32768, 4096), np.uint8)
    for r in maps:
        places[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(places.ravel(), bitorder="little").astype(bool)
        for b in batches:
            b = b.filter(pa.array(wanted[b.column("node").to_numpy() % _PLACES]))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("node"), *columns([_set(t) for t in b.column("text").to_pylist()])], names=["node", *names])

    return _texts(docs).mapInArrow(each, f"node long, {schema}")


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, hashes) of all of `asked` and few others."""
    return _of_asked(docs, asked, lambda sets: [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["hashes"], "hashes array<long>")


def _ring_bytes(sets: list[np.ndarray]) -> list[pa.Array]:
    """A set's size, and its ring in its own size class and in the next one (null if no linked set is there): a byte of each segment's word, 0 for an empty segment."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    own = np.searchsorted(_FIRST, sizes, "right") - 1
    out = [pa.array(sizes)]
    for step, takes in ((0, np.ones(len(sets), bool)), (1, sizes * 5 // 4 >= _FIRST[own + 1])):
        at = np.flatnonzero(takes)
        rings: list[bytes | None] = [None] * len(sets)
        if len(at):
            lengths = _segments(own[at] + step)
            ends = np.cumsum(lengths)
            of, segment, word, _ = _ring(np.concatenate([sets[i] for i in at]), sizes[at], own[at] + step)
            flat = np.zeros(ends[-1], np.uint8)
            flat[(ends - lengths)[of] + segment.astype(np.int64)] = word % np.uint64(255) + np.uint64(1)
            for i, begin, end in zip(at.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                rings[i] = flat[begin:end].tobytes()
        out.append(pa.array(rings, pa.binary()))
    return out


def _viable(differ: np.ndarray, budget: int) -> bool:
    """Whether from some start on the ring chains of 1, 2, 4, ... segments, at last all, keep within their share of `budget` differences."""
    m = len(differ)
    sums = np.concatenate(([0], np.cumsum(np.concatenate((differ, differ)))))
    starts, length = np.arange(m), 1
    while True:
        starts = starts[sums[starts + length] - sums[starts] <= length * budget // m]
        if not len(starts) or length == m:
            return len(starts) > 0
        length = min(2 * length, m)


def chained(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, hub) whose rings hold a viable chain; every linked pair is among them."""
    names = ["n", "own", "next"]
    rings = _of_asked(docs, pairs.select(F.explode(F.array("u", "hub")).alias("node")).distinct(), _ring_bytes, names, "n long, own binary, next binary")
    # renamed after each join, so that both ask for one exchange
    one = pairs.join(rings, F.col("hub") == F.col("node")).select("u", "hub", *[F.col(c).alias(f"hub_{c}") for c in names])
    both = one.join(rings, F.col("u") == F.col("node")).select(*one.columns, *[F.col(c).alias(f"u_{c}") for c in names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("u_n").to_numpy(), b.column("hub_n").to_numpy()
            step = np.searchsorted(_FIRST, m, "right") - np.searchsorted(_FIRST, n, "right")
            keep = (np.minimum(n, m) * 5 >= np.maximum(n, m) * 4) & (np.abs(step) <= 1)
            u, hub = ([b.column(f"{side}_{c}") for c in ("own", "next")] for side in ("u", "hub"))
            for i in np.flatnonzero(keep).tolist():
                x, y = u[int(step[i] > 0)][i].as_buffer(), hub[int(step[i] < 0)][i].as_buffer()
                keep[i] = _viable(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8), int(n[i] + m[i]) // 9)
            yield b.select(["u", "hub"]).filter(pa.array(keep))

    return both.mapInArrow(each, "u long, hub long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar enough; of a crowd's pairs v is the hub."""
    pairs = checkpoint(pairs.select("u", F.col("v").alias("hub")).where("u <> hub").distinct())
    pairs = checkpoint(chained(docs, pairs))
    # the sets' exchange is made once, as both ends ask for the same; a repeated row only repeats a pair.
    # Hubs come first: their pairs are two numbers then, and go apart with the hub's set.
    sets = _sets(docs, pairs.select(F.explode(F.array("u", "hub")).alias("node")).distinct())
    one = pairs.join(sets, F.col("hub") == F.col("node")).select("u", "hub", F.col("hashes").alias("a"))
    both = one.join(sets, F.col("u") == F.col("node")).select("u", F.col("hub").alias("v"), "a", F.col("hashes").alias("b"))
    n, m = F.size("a"), F.size("b")
    return checkpoint(both.where((F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (F.size(F.array_intersect("a", "b")) * 9 >= (n + m) * 4)).select("u", "v").distinct())


def _columns(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the hashes that are in `common`, by column."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
    held = np.flatnonzero(common[at] == flat) if len(common) else np.zeros(0, np.int64)
    held = held[np.argsort(at[held], kind="stable")]
    return at[held], row[held]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of `a` shares with each of `b`: frequent hashes by products of 0/1 matrices, others by their pairs of rows."""
    shared = np.zeros((len(a), len(b)), np.float32)
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    (ca, ra), (cb, rb) = _columns(a, common), _columns(b, common)
    na, nb = np.bincount(ca, minlength=len(common)), np.bincount(cb, minlength=len(common))
    frequent = na * nb * 64 > shared.size
    number = np.cumsum(frequent) - 1
    fa, fb = frequent[ca], frequent[cb]
    for i in range(0, int(frequent.sum()), SLICE_COLUMNS):
        x, y = np.zeros((len(a), SLICE_COLUMNS), np.float32), np.zeros((len(b), SLICE_COLUMNS), np.float32)
        for m, c, r, f in ((x, ca, ra, fa), (y, cb, rb, fb)):
            here = f & (number[c] // SLICE_COLUMNS == i // SLICE_COLUMNS)
            m[r[here], number[c[here]] - i] = 1
        shared += x @ y.T
    ca, ra = ca[~fa], ra[~fa]
    begins = np.cumsum(nb) - nb
    ends = np.cumsum(nb[ca])
    i = 0
    while i < len(ca):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 18), "right")))
        k = nb[ca[i:j]]
        at = np.repeat(begins[ca[i:j]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        shared += np.bincount(np.repeat(ra[i:j], k) * len(b) + rb[at], minlength=shared.size).reshape(shared.shape)
        i = j
    return shared


def _forest(low: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches over the edges x, y and the trees that `low` (each node's root) says already."""
    while True:
        least = np.minimum(low[x], low[y])
        now = low.copy()
        for end in (x, y):
            np.minimum.at(now, low[end], least)  # roots meet, and what hangs on them follows
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _linked(left: pa.Table, right: pa.Table) -> pa.Table:
    """Edges (u, v) that join all nodes linked between two blocks, at most one for each node. Columns 5 and 6 are node and hashes."""

    def side(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        nodes, first = np.unique(t.column(5).to_numpy(), return_index=True)
        return nodes, [x.values.to_numpy().view(np.uint64) for x in t.column(6).take(pa.array(first))]

    (us, a), (vs, b) = (side(t) if t.num_rows else (np.zeros(0, np.int64), []) for t in (left, right))
    if not len(us) or not len(vs):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    nodes, at = np.unique(np.concatenate((us, vs)), return_inverse=True)
    low = np.arange(len(nodes))
    for i in range(0, len(a), SLICE_ROWS):
        x, y = np.nonzero(_overlaps(a[i : i + SLICE_ROWS], b) * 9 >= (n[i : i + SLICE_ROWS, None] + m[None, :]) * 4)
        low = _forest(low, at[i + x], at[len(us) + y])
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return pa.table({"u": nodes[moved], "v": nodes[low[moved]]})


def _rest_links(docs: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (u, v) that join what is linked in a cluster (hub, node) beyond the largest component that `edges` leave there."""
    placed = checkpoint(members.join(components(edges), "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component")))
    largest = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("hub").agg(F.max_by("component", F.struct("c", "component")).alias("done"), F.count(F.lit(1)).alias("parts"))
    asked = checkpoint(placed.join(largest.where("parts > 1"), "hub").select("hub", "node", (F.col("component") != F.col("done")).alias("rest")))
    salt = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(SALTS)).cast("int")
    # the base is a little over 5 / 4, so that sets of similar sizes are at most one step apart
    held = asked.join(_sets(docs, asked.select("node").distinct()), "node").select("hub", "node", "rest", "hashes", F.floor(F.log(F.size("hashes")) / float(np.log(1.26))).cast("int").alias("step"), salt.alias("salt"))
    held = checkpoint(held)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.size("hashes")) / BLOCK_HASHES)).cast("int")
        return rows.groupBy("hub", F.col("step").alias(f"{name}_step")).agg(n.alias(f"{name}_blocks"))

    of_rest = blocks(held.where("rest"), "l").withColumn("r_step", F.explode(F.array(*[F.col("l_step") + d for d in (-1, 0, 1)])))
    met = of_rest.join(blocks(held, "r"), ["hub", "r_step"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = checkpoint(met)
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda name: held.withColumnRenamed("step", name)
    left = sized("l_step").where("rest").join(met, ["hub", "l_step", "salt"]).select("hub", "l_step", "r_step", block(F.col("l_blocks")).alias("l"), every("r_blocks").alias("r"), "node", "hashes")
    right = sized("r_step").join(met, ["hub", "r_step", "salt"]).select("hub", "l_step", "r_step", every("l_blocks").alias("l"), block(F.col("r_blocks")).alias("r"), "node", "hashes")
    task = ["hub", "l_step", "r_step", "l", "r"]
    right = right.toDF("hub_", "l_step_", "r_step_", "l_", "r_", "node_", "hashes_")  # columns of its own, as both come from `held`
    return checkpoint(left.groupBy(*task).cogroup(right.groupBy(*[f"{c}_" for c in task])).applyInArrow(_linked, "u long, v long").distinct())


def links(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between nodes whose components are those of all links."""
    # one exchange, read three times; a crowd's rows pass a task one by one, none is held
    found = keys(docs).where("key IS NOT NULL AND node IS NOT NULL").repartition("key")  # said for all readers, as a join would add it for its own
    sizes = found.groupBy("key").agg(F.count("node").alias("c"), F.min("node").alias("low"), F.max("node").alias("high")).where("c > 1 AND low <> high")
    two = sizes.where("c = 2").select(F.lit(None).cast("long").alias("key"), F.col("high").alias("node"), F.col("low").alias("other"), "c").distinct()
    more = found.join(sizes.where("c > 2").select("key", "c"), "key").select("key", "node", F.lit(None).cast("long").alias("other"), "c")
    met = checkpoint(two.union(more))
    small, large = met.where((F.col("c") > 2) & (F.col("c") <= crowd)).select("key", "node"), met.where(F.col("c") > crowd).select("key", "node")
    pairs = small.select("key", F.col("node").alias("u")).join(small.select("key", F.col("node").alias("v")), "key").where("u > v").select("u", "v")
    pairs = pairs.union(met.where("c = 2").select("node", "other")).distinct()

    weights = large.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    weighed = checkpoint(large.join(weights, "node"))
    hubs = weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    members = checkpoint(weighed.join(hubs, "key").select("hub", "node").distinct())
    edges = _verified(docs, pairs.union(members.select(F.col("node").alias("u"), F.col("hub").alias("v"))))
    return edges.union(_rest_links(docs, members, edges))


def _placed(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, node, component) for each distinct doc_id and text."""
    nodes = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("node")).distinct()
    return nodes.join(components(links(docs, crowd)), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) for each distinct doc_id and text: component_id is the smallest doc_id reachable over links, itself included."""
    placed = checkpoint(_placed(docs, crowd))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", "component_id")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each near-duplicate group the row with the smallest doc_id (of rows that share it, one), all columns kept."""
    stay = _placed(docs).groupBy("component").agg(F.min_by("node", F.struct("doc_id", "node")).alias("_node")).select("_node")
    return rows_by(docs.where("doc_id IS NOT NULL"), {"_node": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))}, stay)
