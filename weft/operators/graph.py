"""Hierarchies, orders and neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.ordered import met_on, row_numbers

#: Sets in a block of shared_jaccard, items counted together, edges that spanning_edges takes in at once, rows of a closure in one partition.
SIDE, ITEMS, EDGES, AT_ONCE = 2048, 4096, 1 << 20, 1 << 20


def neighbour_window(df: DataFrame, group: Sequence[str], order: str, reach: int, name: str = "window") -> DataFrame:
    """The keys of up to `reach` rows on either side, and whether the window is cut off at an end.

    Rows are numbered by ranges and cut into stretches that overlap by `reach`, so that no
    task holds a whole group. `order` is unique within the group.
    """
    k, long = F.col("_k"), max(4096, 4 * reach)
    numbered = row_numbers(df, list(group), [order], "_k").withColumn("_s", F.explode(F.array_distinct(F.array(F.floor((k - reach) / long), F.floor(k / long), F.floor((k + reach) / long)))))
    w = Window.partitionBy(*group, "_s").orderBy("_k").rowsBetween(-reach, reach)
    seen = numbered.select("*", F.collect_list(order).over(w).alias(name), (F.count(F.lit(1)).over(w) < 2 * reach + 1).alias("edge"))
    return seen.where(F.floor(k / long) == F.col("_s")).drop("_k", "_s")


def ancestors(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, ancestor, depth) over edges (node, parent), each pair once with its least depth.

    Paths double in length every round: a least path of more than `reach` steps is one of
    `reach` and a least rest of at most that, so only pairs at that depth are joined to what
    is met so far, and rounds grow with the logarithm of the depth. Where a node has one
    parent no pair comes up twice, and what is met is not looked at again. Fails on a cycle.
    Only rows of nodes that are someone's parent can be a rest, so no others are sent to be one.
    """
    edges = edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    inner = edges.select(F.col("ancestor").alias("node"), F.lit(True).alias("_inner")).distinct()
    fresh = checkpoint(edges.join(inner, "node", "left").select("node", "ancestor", "depth", F.col("_inner").isNotNull().alias("_inner")))
    found, n, reach = fresh, 0, 1
    tree = not found.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    while True:
        # only rows of the last round can close a cycle, or be of this depth
        more, ends, deepest, closed = fresh.agg(F.count(F.lit(1)), F.count_if(F.col("depth") == reach), F.max("depth"), F.count_if(F.col("node") == F.col("ancestor"))).first()
        if closed:
            raise ValueError("the hierarchy has a cycle")
        if not ends:
            return found.drop("_inner")
        if deepest > max_depth:
            raise ValueError(f"the hierarchy is deeper than {max_depth}")
        n = n + more if tree else more
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // AT_ONCE))
        last = fresh.where(F.col("depth") == reach).repartition(parts, "ancestor")
        up = found.where("_inner").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("depth").alias("_more")).repartition(parts, "ancestor")
        longer = last.join(up, "ancestor").select("node", F.col("_top").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"), "_inner")
        if tree:
            fresh = checkpoint(longer)
            found = found.union(fresh)
        else:
            found = fresh = checkpoint(found.union(longer).repartition(2 * parts, "node", "ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"), F.max("_inner").alias("_inner")))
        reach *= 2


def path_distance(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """(a, b, ancestor, distance) through the nearest common ancestor; a node is its own ancestor at depth 0.

    `closure` must have (node, node, 0) rows as well; see with_self(). A node's ancestors
    travel as one row, so a pair stays a row, and from the nearest to the farthest: rows
    that follow each other then mostly repeat depths and far ancestors, and compress.
    """
    held = closure.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("depth").cast("int").alias("depth"), "ancestor"))).alias("_up"))
    side = lambda name, k: held.select(F.col("node").alias(name), F.col("_up.ancestor").alias(f"_n{k}"), F.col("_up.depth").alias(f"_d{k}"))
    met = pairs.select("a", "b").distinct().join(side("a", 1), "a").join(side("b", 2), "b")
    depth = lambda k, x: F.get(f"_d{k}", F.array_position(f"_n{k}", x).cast("int") - 1)
    shared = F.transform(F.array_intersect("_n1", "_n2"), lambda x: F.struct((depth(1, x) + depth(2, x)).alias("distance"), x.alias("ancestor")))
    return met.select("a", "b", F.array_min(shared).alias("m")).where("m IS NOT NULL").select("a", "b", "m.ancestor", "m.distance")


def with_self(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    return closure.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def shared_jaccard(members: DataFrame, ident: str, item: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, a, b, jaccard) for a < b whose sets share an item; pairs that share none are not made.

    Rare items are joined. Where items are so common that the join would have a row for
    every sixteenth pair of sets or more, all blocks of sets meet instead and shared items
    are counted by products of matrices: no pair travels, only the blocks do. The result
    is quadratic in the sets then, and so is the time.
    """
    own = list(group)
    m = checkpoint(members.select(*own, ident, item).distinct())
    if _common(m, ident, item, own):
        return _jaccard_of_blocks(m, ident, item, own)
    return _jaccard_of_items(m, ident, item, own)


def _common(m: DataFrame, ident: str, item: str, own: list[str]) -> bool:
    """Whether a join on items would have a row for every sixteenth pair of sets or more, and there are many pairs."""
    held = m.groupBy(*own, item).agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0.0
    sets = m.groupBy(*own, ident).agg(F.count(F.lit(1)).alias("n"))
    every = sets.groupBy(*own).agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0.0
    return held * 16 >= every and every > SIDE


def _jaccard_of_items(m: DataFrame, ident: str, item: str, own: list[str]) -> DataFrame:
    """shared_jaccard of distinct members by a join on items."""
    sets = m.groupBy(*own, ident).agg(F.count(F.lit(1)).alias("n"))
    a, b = m.withColumnRenamed(ident, "a"), m.withColumnRenamed(ident, "b")
    both = a.join(b, [*own, item]).where("a < b").groupBy(*own, "a", "b").agg(F.count(F.lit(1)).alias("k"))
    met = both.join(sets.withColumnRenamed(ident, "a").withColumnRenamed("n", "na"), [*own, "a"]).join(sets.withColumnRenamed(ident, "b").withColumnRenamed("n", "nb"), [*own, "b"])
    return met.select(*own, "a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def _pairs_of_blocks(m: DataFrame, ident: str, item: str, own: list[str]) -> DataFrame:
    """(group, _same, _sets, _others): all pairs of blocks of SIDE sets, in the order of their ids."""
    m = m.dropna(subset=[*own, ident, item])
    places = row_numbers(m.select(*own, ident).distinct(), own, [ident], "_k")
    codes = row_numbers(m.select(*own, item).distinct(), own, [item], "_code")
    sets = met_on(met_on(m, codes, [*own, item]), places, [*own, ident]).groupBy(*own, "_k", F.col(ident).alias("id")).agg(F.collect_list(F.col("_code").cast("int")).alias("has"))
    blocks = checkpoint(sets.groupBy(*own, F.floor((F.col("_k") - 1) / SIDE).alias("_i")).agg(F.sort_array(F.collect_list(F.struct("id", "has"))).alias("_sets")))
    last = blocks.groupBy(*own).agg(F.max("_i").alias("_last"))
    left = met_on(blocks, last, own).withColumn("_j", F.explode(F.sequence("_i", "_last")))
    right = blocks.withColumnRenamed("_i", "_j").withColumnRenamed("_sets", "_others")
    pairs = left.join(right.hint("merge"), [*own, "_j"]).select(*own, (F.col("_i") == F.col("_j")).alias("_same"), "_sets", "_others")
    return pairs.repartition(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # small rows that stand for much work


def _met_blocks(batch: pa.RecordBatch, r: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sizes of the sets of two blocks, and how many items each pair of them shares."""

    def unpacked(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, the set of each member and its code."""
        rows = column.flatten()
        has = rows.field("has")
        sizes = np.diff(has.offsets.to_numpy())
        return rows.field("id"), np.repeat(np.arange(len(rows)), sizes), has.flatten().to_numpy()

    (ids, at, code), (other, bt, other_code) = (unpacked(batch.column(c).slice(r, 1)) for c in ("_sets", "_others"))
    na, nb = np.bincount(at, minlength=len(ids)), np.bincount(bt, minlength=len(other))
    common = np.intersect1d(code, other_code)
    shared = np.zeros((len(ids), len(other)), np.float32)
    for first in range(0, len(common), ITEMS):
        some = common[first : first + ITEMS]
        x, y = np.zeros((len(ids), len(some)), np.float32), np.zeros((len(other), len(some)), np.float32)
        for matrix, owner, own_code in ((x, at, code), (y, bt, other_code)):
            place = np.minimum(np.searchsorted(some, own_code), len(some) - 1)
            hit = some[place] == own_code
            matrix[owner[hit], place[hit]] = 1
        shared += x @ y.T
    return ids, other, na, nb, shared


def _jaccard_of_blocks(m: DataFrame, ident: str, item: str, own: list[str]) -> DataFrame:
    """shared_jaccard of distinct members by pairs of blocks; a pair is made where it is handed on."""
    pairs = _pairs_of_blocks(m, ident, item, own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, other, na, nb, shared = _met_blocks(batch, r)
                if batch.column("_same")[r].as_py():
                    shared = np.triu(shared, 1)
                for top in range(0, len(ids), 128):
                    part = shared[top : top + 128]
                    i, j = np.nonzero(part)
                    k = part[i, j].astype(np.float64)
                    named = [pa.repeat(batch.column(c)[r], len(i)) for c in own]
                    yield pa.RecordBatch.from_arrays([*named, ids.take(pa.array(i + top)), other.take(pa.array(j)), pa.array(k / (na[i + top] + nb[j] - k))], names=[*own, "a", "b", "jaccard"])

    kinds = {f.name: f.dataType.simpleString() for f in m.schema}
    return pairs.mapInArrow(count, ", ".join([*[f"`{c}` {kinds[c]}" for c in own], f"a {kinds[ident]}", f"b {kinds[ident]}", "jaccard double"]))


def forest_of(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the maximum spanning forest, ties by a, b: Boruvka's rounds on arrays."""
    order = np.lexsort((b, a, -w))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    n, m = len(nodes), len(a)
    every, part, live, picked = np.arange(n), np.arange(n), np.arange(m), [np.zeros(0, np.int64)]
    while True:
        pu, pv = part[u[live]], part[v[live]]
        apart = pu != pv
        live, pu, pv = live[apart], pu[apart], pv[apart]
        if not len(live):
            return order[np.concatenate(picked)]
        best, other = np.full(n, m), np.full(n, m)
        best[pu[::-1]], other[pv[::-1]] = live[::-1], live[::-1]  # the last one written is the first in order
        best = np.minimum(best, other)
        held = np.flatnonzero(best < m)
        picked.append(np.unique(best[held]))
        to = every.copy()
        to[held] = part[u[best[held]]] + part[v[best[held]]] - held
        ring = (to[to] == every) & (every < to)
        to[ring] = every[ring]
        while (to[to] != to).any():
            to = to[to]
        part = to[part]


def _forest_of_pairs(w: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the maximum spanning forest of all pairs that weigh over 0, ties by row and column; with `same`, rows are columns and only those above the diagonal count.

    The best edge of every node is in it, and so is the forest of all edges from a
    threshold on. Of the other edges only those between the parts that these make can be.
    """
    n, m = w.shape
    if same:
        to = w.argmax(1)
        held = np.flatnonzero(w[np.arange(n), to] > 0)
        best = np.stack([np.minimum(held, to[held]), np.maximum(held, to[held])])
        w, nodes = np.triu(w, 1), len(held)
    else:
        to, back = w.argmax(1), w.argmax(0)
        rows, cols = np.flatnonzero(w[np.arange(n), to] > 0), np.flatnonzero(w[back, np.arange(m)] > 0)
        best, nodes = np.concatenate([np.stack([rows, to[rows]]), np.stack([back[cols], cols])], axis=1), len(rows) + len(cols)
    some = np.sort(w[:: 1 + n // 128, :: 1 + m // 128], axis=None)
    least = some[-max(1, len(some) // 256)]
    i, j = np.nonzero(w >= least if least > 0 else w > 0)
    for last in (False, True):
        i, j = np.divmod(np.unique(np.concatenate([i * m + j, best[0] * m + best[1]])), m)
        kept = forest_of(i, j if same else j + n, w[i, j]) if len(i) else np.zeros(0, np.int64)
        i, j = i[kept], j[kept]
        if last or len(kept) == nodes - 1 or least <= 0:
            return i, j
        part = _labels(i, j if same else j + n, n if same else n + m)
        across = np.nonzero((part[:n, None] != part[-m:]) & (w > 0))
        best, i, j = np.stack([i, j]), *across


def _labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that edges connect it to."""
    part = np.arange(n)
    while True:
        low, to = np.minimum(part[u], part[v]), part.copy()
        np.minimum.at(to, part[u], low)
        np.minimum.at(to, part[v], low)
        while (to[to] != to).any():
            to = to[to]
        if (to == part).all():
            return part
        part = to


def jaccard_spanning_edges(members: DataFrame, ident: str, item: str, extra: float) -> DataFrame:
    """spanning_edges of shared_jaccard. Where items are common, a task that counts what two blocks of sets share hands on their forest and the edges of at least `extra`, and no other pair is made."""
    m = checkpoint(members.select(ident, item).distinct())
    if not _common(m, ident, item, []):
        return spanning_edges(_jaccard_of_items(m, ident, item, []), "jaccard", extra)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, other, na, nb, shared = _met_blocks(batch, r)
                same = batch.column("_same")[r].as_py()
                w = shared.astype(np.float64)
                w /= na[:, None] + nb - w
                if same:
                    np.fill_diagonal(w, 0)
                i, j = _forest_of_pairs(w, same)
                near = np.nonzero(np.triu(w >= extra, 1) if same else w >= extra) if extra > 0 else np.nonzero(np.triu(w, 1) if same else w)
                for i, j in ((i, j), near):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), other.take(pa.array(j)), pa.array(w[i, j])], names=["a", "b", "jaccard"])

    kind = m.schema[ident].dataType.simpleString()
    return spanning_edges(_pairs_of_blocks(m, ident, item, []).mapInArrow(forests, f"a {kind}, b {kind}, jaccard double"), "jaccard", extra)


def spanning_edges(edges: DataFrame, weight: str, extra: float) -> DataFrame:
    """(a, b, weight): a maximum spanning forest, and the edges of at least `extra`; edges without a weight are none.

    Every partition first keeps the forest of its own edges (no other edge of it can be in
    the whole forest) and those of at least `extra`, so edges are read once and not stored;
    then eight partitions' forests at a time become one.
    Then Boruvka's rounds: each component takes its best edge (ties by a, b), components
    that chose each other merge, and edges within a component go; rounds grow with the
    logarithm of the nodes. Only counts reach the driver.
    """
    given = edges.select("a", "b", F.col(weight).alias("w")).where("a <> b AND w IS NOT NULL")

    def own_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def reduced() -> pa.Table:
            t = pa.Table.from_batches(waiting).combine_chunks()
            return t.take(pa.array(forest_of(*(t.column(c).to_numpy() for c in ("a", "b", "w")))))

        for batch in batches:
            yield batch.filter(pa.array(batch.column("w").to_numpy() >= extra))
            waiting.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                kept = reduced()
                waiting, n = kept.to_batches(), max(0, kept.num_rows - EDGES // 2)
        if waiting:
            yield from reduced().to_batches()

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fewer = given.mapInArrow(own_forest, given.schema).repartition(-(-parts // 8))  # forests of many partitions overlap: those of eight become one
    e = checkpoint(fewer.mapInArrow(own_forest, given.schema).distinct())
    across = e.select("a", "b", "w", F.col("a").alias("pa"), F.col("b").alias("pb"))
    chosen = e.where("false")
    while True:
        both = across.union(across.select("a", "b", "w", "pb", "pa"))
        best = checkpoint(both.groupBy("pa").agg(F.max(F.struct("w", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), "pb")).alias("m")).select("pa", "m.pb", (-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"), "m.w"))
        if not best.limit(1).count():
            return chosen.union(e.where(F.col("w") >= extra)).distinct().withColumnRenamed("w", weight)
        chosen = chosen.union(best.select("a", "b", "w"))
        label = components(best.select(F.col("pa").cast("long").alias("u"), F.col("pb").cast("long").alias("v")))
        to_a, to_b = label.select(F.col("node").alias("pa"), F.col("component").alias("qa")), label.select(F.col("node").alias("pb"), F.col("component").alias("qb"))
        across = checkpoint(across.join(to_a, "pa").join(to_b, "pb").where("qa <> qb").select("a", "b", "w", F.col("qa").alias("pa"), F.col("qb").alias("pb")))


def robinson_foulds(bipartitions: DataFrame, tree: str, split: str, leaves: int) -> DataFrame:
    """(a, b, distance): normalised distance of all trees a < b from their bipartitions, `leaves` common leaves."""
    m = bipartitions.select(tree, split).distinct()
    size = m.groupBy(tree).agg(F.count(F.lit(1)).alias("n"))
    a, b = size.select(F.col(tree).alias("a"), F.col("n").alias("na")), size.select(F.col(tree).alias("b"), F.col("n").alias("nb"))
    common = m.withColumnRenamed(tree, "a").join(m.withColumnRenamed(tree, "b"), split).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(common, ["a", "b"], "left")
    return pairs.select("a", "b", ((F.col("na") + F.col("nb") - 2 * F.coalesce("k", F.lit(0))) / (2 * (leaves - 3))).alias("distance"))


def patristic(lengths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance) along a tree; `lengths` is (node, ancestor, depth, length) with each node its own ancestor at 0, length from node up to ancestor."""
    left = lengths.select(F.col("node").alias("a"), "ancestor", F.col("length").alias("la"))
    right = lengths.select(F.col("node").alias("b"), "ancestor", F.col("length").alias("lb"))
    return pairs.join(left, "a").join(right, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.col("la") + F.col("lb")).alias("distance"))


def rooted(edges: DataFrame, tree: str, outgroup: str) -> DataFrame:
    """(tree, node, parent, label, branch_length) of trees rooted on the branch above the leaf called `outgroup`.

    `edges` is as readers.newick_edges returns it, the old root without a parent. The new
    root is node -1; the branch above the outgroup is halved, the branches from there to the
    old root turn round, and labels of inner nodes (supports) stay with their branch. An old
    root that is left with one branch below it stays as a node. Trees without the outgroup are left out.
    """
    edges = checkpoint(edges)  # else texts are parsed again for each use
    up = ancestors(_keyed(edges, tree)).withColumnRenamed("node", "_leaf")
    leaf = edges.where(F.col("label") == outgroup).select(tree, "node", F.struct(tree, "node").alias("_leaf"))
    path = leaf.join(up, "_leaf").select(tree, F.col("ancestor.node").alias("node"), "depth").union(leaf.select(tree, "node", F.lit(0)))
    on = edges.join(leaf.select(tree), tree, "left_semi").join(path, [tree, "node"], "left")
    below = path.select(tree, (F.col("depth") + 1).alias("depth"), F.col("node").alias("_below")).join(edges.select(tree, F.col("node").alias("_below"), F.col("label").alias("_label"), F.col("branch_length").alias("_length")), [tree, "_below"])
    met = on.join(below, [tree, "depth"], "left")
    d, half = F.col("depth"), F.col("branch_length") / 2
    turned = met.select(
        tree,
        "node",
        F.when(d.isNull(), F.col("parent")).when(d <= 1, F.lit(-1)).otherwise(F.col("_below")).cast("long").alias("parent"),
        F.when(d.isNull() | (d == 0), F.col("label")).when(d == 1, F.lit("")).otherwise(F.col("_label")).alias("label"),
        F.when(d.isNull(), F.col("branch_length")).when(d == 0, half).when(d == 1, F.col("_length") / 2).otherwise(F.col("_length")).alias("branch_length"),
    )
    return checkpoint(turned.union(leaf.select(tree, F.lit(-1).cast("long"), F.lit(None).cast("long"), F.lit(""), F.lit(None).cast("double"))))


def _keyed(edges: DataFrame, tree: str) -> DataFrame:
    """(node, parent) over all trees, a node named by its tree and its number."""
    name = lambda c: F.struct(tree, F.col(c).alias("node"))
    return edges.select(name("node").alias("node"), F.when(F.col("parent").isNotNull(), name("parent")).alias("parent"))


def tip_order(edges: DataFrame, tree: str) -> DataFrame:
    """(tree, label, place) of leaves from first to last with branches of few leaves first (ladder order), ties by node."""
    up = ancestors(_keyed(edges, tree))
    leaf = edges.join(edges.select(tree, F.col("parent").alias("node")).distinct(), [tree, "node"], "left_anti").select(tree, "label", F.struct(tree, "node").alias("_leaf"))
    whole = leaf.join(up.withColumnRenamed("node", "_leaf"), "_leaf").select(tree, "label", "_leaf", "ancestor", "depth").union(leaf.select(tree, "label", "_leaf", F.col("_leaf"), F.lit(0)))
    size = whole.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))
    step = F.struct((-F.col("depth")).alias("d"), F.struct("n", F.col("ancestor.node").alias("node")).alias("s"))
    keyed = whole.join(size, "ancestor").groupBy(tree, "label", "_leaf").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x.s).alias("_way"))
    return row_numbers(keyed, [tree], ["_way", "_leaf"], "place").select(tree, "label", "place")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reached.

    `edges` has long columns u and v; loops, repeats and either direction are allowed.
    Each round is two grouped minima (combined before the shuffle, so a node of any
    degree is safe) joined back to the edges; rounds grow with the logarithm of the
    longest path. Nothing but a count and a checksum reaches the driver.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = checkpoint(e)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
