"""Values over forests of rooted trees: folds from the leaves, distances from the root, layouts, splits.

Trees are edges (tree, node, parent, label, branch_length) as readers.newick_edges gives
them: nodes numbered in order of appearance, the root without a parent. Deep trees cost a
number of rounds that grows with the logarithm of their nodes, not with their depth, and a
round's rows are the nodes: nothing holds every pair of a node and its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.ordered import met_on, row_numbers

MANY_ROUNDS = 100


def root_distances(edges: DataFrame, tree: str, length: Column | None = None) -> DataFrame:
    """(tree, node, distance): branch lengths added up from the root, missing ones as zero. Paths double in length every round."""
    step = F.coalesce(F.col("branch_length") if length is None else length, F.lit(0.0)).cast("double")
    state = checkpoint(edges.select(tree, "node", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), step).otherwise(0.0).alias("distance")))
    for _ in range(MANY_ROUNDS):
        if not state.where("up IS NOT NULL").limit(1).count():
            return state.select(tree, "node", "distance")
        above = state.select(F.col(tree), F.col("node").alias("up"), F.col("up").alias("_up"), F.col("distance").alias("_more"))
        state = checkpoint(state.join(above, [tree, "up"], "left").select(tree, "node", F.col("_up").alias("up"), (F.col("distance") + F.coalesce("_more", F.lit(0.0))).alias("distance")))
    raise ValueError("a tree has a cycle")


def fold_up(edges: DataFrame, leaves: DataFrame, tree: str, mean: bool = False, own: float = 0.0) -> DataFrame:
    """(tree, node, value): a leaf's value is that in `leaves` (tree, node, value), an inner node's is `own` plus the sum (or mean) of its children's.

    Rake and compress: a node whose children are known gets its value; a node with one
    unknown child is a linear function of it, and such functions are composed along
    chains, so that a chain halves every round. A leaf without a value is an error.
    """
    parents = edges.where("parent IS NOT NULL").groupBy(tree, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_k"))
    start = edges.select(tree, "node", "parent").join(leaves.select(tree, "node", F.col("value").cast("double").alias("value")), [tree, "node"], "left").join(parents, [tree, "node"], "left")
    if start.where("_k IS NULL AND value IS NULL").limit(1).count():
        raise ValueError("a leaf has no value")
    none = F.lit(None).cast("double")
    inner = F.when(F.col("_k").isNull(), F.col("value"))
    state = checkpoint(start.select(tree, "node", "parent", (1 / F.col("_k") if mean else F.when(F.col("_k").isNotNull(), 1.0)).alias("w"), inner.alias("value"), F.lit(None).cast("long").alias("to"), none.alias("a"), none.alias("b")))
    for _ in range(MANY_ROUNDS):
        if not state.where("value IS NULL").limit(1).count():
            return state.select(tree, "node", "value")
        kids = state.where("parent IS NOT NULL").groupBy(tree, F.col("parent").alias("node")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_s"), F.count_if(F.col("value").isNull()).alias("_open"), F.min(F.when(F.col("value").isNull(), F.col("node"))).alias("_only"))
        ends = state.select(tree, F.col("node").alias("to"), F.col("value").alias("_v"), F.col("to").alias("_to"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        met = state.join(kids, [tree, "node"], "left").join(ends, [tree, "to"], "left")
        here = own + F.col("w") * F.col("_s")
        value = F.coalesce("value", F.when(F.col("_open") == 0, here), F.col("a") * F.col("_v") + F.col("b"))
        fresh, jump = F.col("to").isNull() & (F.col("_open") == 1), F.col("_to").isNotNull()
        state = checkpoint(
            met.select(
                tree, "node", "parent", "w", value.alias("value"),
                F.when(fresh, F.col("_only")).when(jump, F.col("_to")).otherwise(F.col("to")).alias("to"),
                F.when(fresh, F.col("w")).when(jump, F.col("a") * F.col("_a")).otherwise(F.col("a")).alias("a"),
                F.when(fresh, here).when(jump, F.col("b") + F.col("a") * F.col("_b")).otherwise(F.col("b")).alias("b"),
            )
        )
    raise ValueError("a tree has a cycle")


def tips(edges: DataFrame, tree: str) -> DataFrame:
    """(tree, node, label) of nodes without children."""
    inner = edges.where("parent IS NOT NULL").select(tree, F.col("parent").alias("node")).distinct()
    return edges.select(tree, "node", "label").join(inner, [tree, "node"], "left_anti")


def layout(edges: DataFrame, tree: str) -> DataFrame:
    """(tree, node, x, y): x the distance from the root (in branches, where a tree's lengths are all zero), y the place of a tip, or the mean of a node's children."""
    edges = checkpoint(edges)
    plain = edges.groupBy(tree).agg((F.coalesce(F.max(F.when(F.col("parent").isNotNull(), F.col("branch_length"))), F.lit(0.0)) == 0).alias("_plain"))
    x = root_distances(met_on(edges, plain, [tree]), tree, F.when(F.col("_plain"), 1.0).otherwise(F.col("branch_length")))
    places = row_numbers(tips(edges, tree).select(tree, "node"), [tree], ["node"], "_p").select(tree, "node", (F.col("_p") - 1).alias("value"))
    y = fold_up(edges, places, tree, mean=True)
    return x.select(tree, "node", F.col("distance").alias("x")).join(y.withColumnRenamed("value", "y"), [tree, "node"])


def split_distances(edges: DataFrame, pairs: DataFrame, tree: str) -> DataFrame:
    """(a, b, common, differing, distance) for pairs (a, b) of trees: splits of the tips both have that only one of the two shows, over the 2 (common - 3) that could.

    Trees count as unrooted, and are pruned to the tips that both have, known by label. A
    clade is the sum of two hashes of its tips' labels; nodes are numbered as they appear,
    so a clade is a stretch of them and its sum the difference of two running sums. Of a
    split's sides the one without the first common label names it. Pairs with fewer than
    four tips in common have no distance.
    """
    edges, pairs = checkpoint(edges), pairs.select("a", "b").distinct()
    tip = checkpoint(tips(edges, tree))
    size = fold_up(edges, tip.withColumn("value", F.lit(1.0)), tree, own=1.0).withColumn("size", F.col("value").cast("long")).drop("value")
    of = lambda side: tip.select(F.col(tree).alias(side), "label")
    common = checkpoint(pairs.join(of("a"), "a").join(of("b"), ["b", "label"]).select("a", "b", "label"))
    bits = lambda seed: F.xxhash64(F.lit(seed), "label").bitwiseAND(F.lit((1 << 40) - 1))
    hashed = common.withColumns({"_h": bits(1), "_g": bits(2)})
    whole = hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min("label").alias("_first"), F.sum("_h").alias("_hs"), F.sum("_g").alias("_gs"))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias(tree))
    nodes = edges.select(tree, "node").join(size, [tree, "node"]).join(tip, [tree, "node"], "left")
    valued = sides.join(nodes, tree).join(hashed, ["a", "b", "label"], "left").join(whole, ["a", "b"])
    zero = F.lit(0).cast("long")
    each = {"_n": F.when(F.col("_h").isNotNull(), 1).otherwise(0).cast("long"), "_h": F.coalesce("_h", zero), "_g": F.coalesce("_g", zero), "_r": F.when(F.col("_h").isNotNull() & (F.col("label") == F.col("_first")), 1).otherwise(0).cast("long")}
    order = Window.partitionBy("a", "b", tree).orderBy("node")  # one tree's nodes
    upto = checkpoint(valued.select("a", "b", tree, "node", "size", "common", "_hs", "_gs", *[v.alias(k) for k, v in each.items()]).withColumns({f"c{k}": F.sum(k).over(order) for k in each}))
    last = upto.select("a", "b", tree, F.col("node").alias("_last"), *[F.col(f"c{k}").alias(f"e{k}") for k in each])
    clade = upto.where("size > 1").withColumn("_last", F.col("node") + F.col("size") - 1).join(last, ["a", "b", tree, "_last"])
    total = {k: F.col(f"e{k}") - F.col(f"c{k}") + F.col(k) for k in each}
    held = clade.select("a", "b", tree, "common", "_hs", "_gs", *[v.alias(k) for k, v in total.items()]).where("_n BETWEEN 2 AND common - 2")
    other = F.col("_r") > 0
    split = held.select("a", "b", tree, F.when(other, F.col("_hs") - F.col("_h")).otherwise(F.col("_h")).alias("_h"), F.when(other, F.col("_gs") - F.col("_g")).otherwise(F.col("_g")).alias("_g")).distinct()
    alone = split.groupBy("a", "b", "_h", "_g").agg(F.count(F.lit(1)).alias("_in")).where("_in = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("differing"))
    out = pairs.join(whole.select("a", "b", "common"), ["a", "b"], "left").join(alone, ["a", "b"], "left")
    n = F.coalesce("common", zero)
    differing = F.when(n >= 4, F.coalesce("differing", zero))
    return out.select("a", "b", n.alias("common"), differing.alias("differing"), F.when(n >= 4, differing / (2 * (n - 3))).alias("distance"))
