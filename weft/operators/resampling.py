"""Bootstraps, permutations and jackknives whose draws come from hashes, so any engine can repeat them.

Statistics over all replicates are the kernels of weft.operators.replicates, which keep
rows where they are. `draws`, `weighted`, `permuted_labels` and `chosen_labels` give the
same draws as rows, one for each replicate: for statistics that have no kernel (Spearman
correlations), and for strata too large for a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.hashing import prefix32
from weft.checkpoints import checkpoint
from weft.operators.ordered import met_on, row_numbers
from weft.operators.replicates import HASHES, drawn_medians, drawn_weights, large_strata, permuted, replicate_sums, spearman_bootstrap, weighted_medians

#: Controls of a target's list that are kept at first; blocks up to which Spearman correlations are resampled by sums over blocks.
LISTED, FEW = 16, 64
#: Pairs of a stratum's targets and controls up to which a task assigns a whole replicate of it.
WHOLE = 1 << 28


def draws(blocks: DataFrame, block: str, replicates: int, seed: str, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, replicate, block, weight): as many draws with replacement as a stratum has blocks.

    Slot i of replicate r takes the block numbered hash(seed, stratum, r, i) mod n, blocks
    numbered from 0 in order; blocks that are not drawn have no row.
    """
    numbered = row_numbers(blocks.select(*strata, block).distinct(), list(strata), [block], "_i").withColumn("_i", F.col("_i") - 1)
    n = numbered.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    sized = met_on(numbered, n, list(strata))
    slots = sized.select(*strata, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    parts = [F.lit(seed), *[F.col(s).cast("string") for s in strata], F.col("replicate").cast("string"), F.col("_i").cast("string")]
    picked = slots.select(*strata, "replicate", (prefix32(*parts) % F.col("_n")).alias("_i")).groupBy(*strata, "replicate", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return met_on(picked, numbered, [*strata, "_i"]).select(*strata, "replicate", block, "weight")


def weighted(df: DataFrame, drawn: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the replicate and weight of their block."""
    return met_on(df, drawn, list(on))


def mean_difference_bootstrap(df: DataFrame, block: str, label: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, difference) of the two classes' means over resampled blocks; draws with one class are left out."""
    y, x = F.col(label), F.col(value)
    g = replicate_sums(df, [(drawn_weights(df, block, replicates, seed), [block])], replicates, {"n1": (y == 1).cast("int"), "s1": F.when(y == 1, x), "n0": (y == 0).cast("int"), "s0": F.when(y == 0, x)})
    return g.where("n1 > 0 AND n0 > 0").select("replicate", (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("difference"))


def mean_bootstrap(df: DataFrame, cell: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, mean) over resampled cells, one value a cell."""
    g = replicate_sums(df, [(drawn_weights(df, cell, replicates, seed), [cell])], replicates, {"s": F.col(value), "n": F.lit(1)})
    return g.select("replicate", F.try_divide("s", "n").alias("mean"))


def hierarchical_median(df: DataFrame, group: str, ident: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, median): groups are drawn, then rows within each drawn group, as often as it was drawn."""
    few = drawn_medians(df, group, ident, value, replicates, seed)
    if few is not None:
        return few
    rows = drawn_weights(df, ident, replicates, f"{seed}:rows", [group])
    return weighted_medians(df, [(rows, [group, ident]), (drawn_weights(df, group, replicates, f"{seed}:groups"), [group])], value, replicates)


def permuted_labels(df: DataFrame, strata: Sequence[str], ident: str, label: str, replicates: int, seed: str) -> DataFrame:
    """(strata, replicate, ident, permuted): within a stratum, the label of the row whose place by id is this row's place by hash."""
    by_id = row_numbers(df.select(*strata, ident, label), list(strata), [ident], "_place").select(*strata, "_place", F.col(label).alias("permuted"))
    each = df.select(*strata, ident, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    keyed = each.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), F.col(ident).cast("string")), 256))
    by_hash = row_numbers(keyed, [*strata, "replicate"], ["_h", ident], "_place")
    return met_on(by_hash, by_id, [*strata, "_place"]).select(*strata, "replicate", ident, "permuted")


def leave_one_out(df: DataFrame, block: str, value: str) -> DataFrame:
    """(left_out, mean) of all rows but a block's, from block sums."""
    s = df.groupBy(block).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    t = s.agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    return s.join(F.broadcast(t)).select(F.col(block).alias("left_out"), F.try_divide(F.col("_s") - F.col("s"), F.col("_n") - F.col("n")).alias("mean"))


def empirical_p(null: Column, observed: Column, sides: int = 1) -> Column:
    """Aggregate: (1 + replicates at least as extreme) / (1 + replicates)."""
    beyond = null >= observed if sides == 1 else F.abs(null) >= F.abs(observed)
    return (F.count_if(beyond) + 1) / (F.count(null) + 1)


def summary(df: DataFrame, group: Sequence[str], value: str, rope: float) -> DataFrame:
    """(group, low, median, high, above, above_rope, equivalent): 95 % percentile interval, shares, and whether the 90 % interval lies within the rope."""
    q = F.percentile(value, F.array(*map(F.lit, (0.025, 0.05, 0.5, 0.95, 0.975)))).alias("q")
    g = df.groupBy(*group).agg(q, F.avg((F.col(value) > 0).cast("int")).alias("above"), F.avg((F.col(value) >= rope).cast("int")).alias("above_rope"))
    at = lambda i: F.col("q")[i]
    return g.select(*group, at(0).alias("low"), at(2).alias("median"), at(4).alias("high"), "above", "above_rope", ((at(1) > -rope) & (at(3) < rope)).alias("equivalent"))


def stability(df: DataFrame, group: Sequence[str], odds: str, least: float) -> DataFrame:
    """(group, share, robust): how often the odds point up, and whether that is at least `least`."""
    share = F.avg((F.col(odds) > 1).cast("int"))
    return df.groupBy(*group).agg(share.alias("share"), (share >= least).alias("robust"))


def weighted_spearman_matrix(df: DataFrame, group: Sequence[str], columns: Sequence[str], weight: str) -> DataFrame:
    """(group, r_<i>_<j>) Spearman correlations of rows repeated `weight` times, ranks taken anew in each group."""
    from weft.operators.ordered import running_sums

    ranked = df
    for c in columns:
        sizes = df.groupBy(*group, c).agg(F.sum(weight).alias("_n"))
        ends = running_sums(sizes, list(group), [c], {"_end": "_n"}).select(*group, c, (F.col("_end") - (F.col("_n") - 1) / 2.0).alias(f"_r_{c}"))
        ranked = ranked.join(ends, [*group, c])
    w, r = F.col(weight), {c: F.col(f"_r_{c}") for c in columns}
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    sums = ranked.groupBy(*group).agg(
        F.sum(w).alias("_w"),
        *[F.sum(w * r[c]).alias(f"_s{i}") for i, c in enumerate(columns)],
        *[F.sum(w * r[c] * r[c]).alias(f"_q{i}") for i, c in enumerate(columns)],
        *[F.sum(w * r[columns[i]] * r[columns[j]]).alias(f"_c{i}{j}") for i, j in pairs],
    )
    n, s, q = F.col("_w"), lambda i: F.col(f"_s{i}"), lambda i: F.col(f"_q{i}")
    spread = lambda i: q(i) - s(i) * s(i) / n
    return sums.select(*group, *[F.try_divide(F.col(f"_c{i}{j}") - s(i) * s(j) / n, F.sqrt(spread(i) * spread(j))).alias(f"r_{columns[i]}_{columns[j]}") for i, j in pairs])


def spearman_block_bootstrap(df: DataFrame, block: str, columns: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(replicate, r_<i>_<j>) Spearman correlations over resampled blocks; with more than FEW blocks by rows times replicates."""
    if df.select(block).distinct().limit(FEW + 1).count() <= FEW:
        return spearman_bootstrap(df, drawn_weights(df, block, replicates, seed), block, columns, replicates)
    return weighted_spearman_matrix(weighted(df, draws(df, block, replicates, seed), [block]), ["replicate"], columns, "weight")


def partial_of_three(ab: Column, ac: Column, bc: Column) -> Column:
    """Correlation of a and b given c."""
    return F.try_divide(ab - ac * bc, F.sqrt((1 - ac * ac) * (1 - bc * bc)))


def chosen_labels(df: DataFrame, strata: Sequence[str], ident: str, label: str, replicates: int, seed: str) -> DataFrame:
    """(strata, replicate, ident): in each replicate as many rows of a stratum as carry the label, those with the smallest hash."""
    k = df.groupBy(*strata).agg(F.sum(label).alias("_k"))
    each = df.select(*strata, ident, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    keyed = each.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), F.col(ident).cast("string")), 256))
    placed = row_numbers(keyed, [*strata, "replicate"], ["_h", ident], "_place").join(k, list(strata))
    return placed.where("_place <= _k").select(*strata, "replicate", ident)


def assigned_controls(pools: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(replicate, target_id, control_id) from pools (target_id, control_id): targets in order take the control of least hash that the replicate has not used, or of least hash if all of theirs are used.

    The order of targets is resolved by rounds instead of one after another: each target
    asks for the first control on its list, a control keeps the first target in order that
    asks for it, and the others go on to their next. That ends in the same assignment, as
    an earlier target never loses a control to a later one. A target's pool travels once,
    without hashes: the task that hashes it for a range of replicates keeps the LISTED
    first controls of each list. A target that gets to the end of what was kept has its
    pool hashed again for a list four times as long.
    """
    row = F.struct("control_id", F.col("control_id").cast("string").alias("name"))
    packed = checkpoint(pools.distinct().groupBy("target_id").agg(F.sort_array(F.collect_list(row)).alias("_pool")))
    step = F.greatest(F.lit(1), F.floor(F.lit(HASHES) / F.size("_pool")).cast("int"))
    ranges = packed.withColumn("_from", F.explode(F.sequence(F.lit(1), F.lit(replicates), step)))
    first = ranges.select("target_id", "_pool", F.sequence("_from", F.least(F.lit(replicates), F.col("_from") + step - 1)).alias("_in"), F.lit(LISTED).alias("_depth"))
    state = checkpoint(_least_hashed(first, seed).withColumn("_at", F.lit(1)))
    while True:
        asked = state.withColumn("control_id", F.get("_list", F.col("_at") - 1))
        held = asked.where("control_id IS NOT NULL").groupBy("replicate", "control_id").agg(F.min("target_id").alias("_by"))
        lost = F.col("_by") != F.col("target_id")
        met = asked.join(held, ["replicate", "control_id"], "left").withColumn("_lost", F.coalesce(lost, F.lit(False)))
        state = checkpoint(met.select("target_id", "replicate", "_list", "_size", (F.col("_at") + F.col("_lost").cast("int")).alias("_at"), "_lost"))
        ended = (F.col("_at") > F.size("_list")) & (F.col("_at") <= F.col("_size"))
        n, more = state.agg(F.count_if("_lost"), F.count_if(ended)).first()
        if not n:
            return state.select("replicate", "target_id", F.coalesce(F.get("_list", F.col("_at") - 1), F.get("_list", F.lit(0))).alias("control_id"))
        state = state.drop("_lost")
        if more:
            wanted = state.where(ended).groupBy("target_id").agg(F.collect_list("replicate").alias("_in"), (4 * F.max("_at")).alias("_depth"))
            longer = _least_hashed(packed.join(wanted, "target_id").select("target_id", "_pool", "_in", "_depth"), seed).select("target_id", "replicate", F.col("_list").alias("_longer"))
            state = checkpoint(state.join(longer, ["target_id", "replicate"], "left").select("target_id", "replicate", F.coalesce("_longer", "_list").alias("_list"), "_size", "_at"))


def assigned_controls_within(targets: DataFrame, controls: DataFrame, strata: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """assigned_controls where a target's pool are the controls of its stratum: the same result from targets (strata, target_id) and controls (strata, control_id), without a row for each pair.

    Replicates and strata touch no other, so a task takes a stratum and a range of
    replicates and assigns its targets in order; one target's hashes are held at a time.
    Strata of more than WHOLE pairs, and targets or controls of several strata, go by
    pairs.
    """
    own = list(strata)
    targets, controls = (checkpoint(x.select(*own, c).dropna(subset=own).distinct()) for x, c in ((targets, "target_id"), (controls, "control_id")))
    by_pairs = lambda t: assigned_controls(t.join(controls, own).select("target_id", "control_id"), replicates, seed)
    if any(x.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() for x, c in ((targets, "target_id"), (controls, "control_id"))):
        return by_pairs(targets)
    sizes = targets.groupBy(*own).agg(F.count(F.lit(1)).alias("_t")).join(controls.groupBy(*own).agg(F.count(F.lit(1)).alias("_c")), own).select(*own, (F.col("_t") * F.col("_c")).alias("_pairs"))
    small = checkpoint(sizes.where(F.col("_pairs") <= WHOLE))

    def packed(x: DataFrame, c: str, name: str) -> DataFrame:
        return x.join(small.select(*own), own).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(F.col(c).alias("id"), F.col(c).cast("string").alias("name")))).alias(name))

    step = F.greatest(F.lit(1), F.floor(F.lit(4 * HASHES) / F.col("_pairs"))).cast("int")
    tasks = small.withColumn("_step", step).withColumn("_from", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.col("_step"))))
    tasks = tasks.join(packed(targets, "target_id", "_targets"), own).join(packed(controls, "control_id", "_controls"), own)
    kind = {**dict(targets.dtypes), **dict(controls.dtypes)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            for k in range(b.num_rows):
                t, c = (b.column(x).slice(k, 1).flatten() for x in ("_targets", "_controls"))
                names, order = [x.encode() for x in c.field("name").to_pylist()], t.field("name").to_pylist()
                first = b.column("_from")[k].as_py()
                for r in range(first, min(replicates + 1, first + b.column("_step")[k].as_py())):
                    left, picks = np.ones(len(names), bool), np.empty(len(order), np.int64)
                    for i, target in enumerate(order):
                        head = f"{seed}|{r}|{target}|".encode()
                        raw = b"".join([sha(head + x).digest() for x in names])
                        key = np.frombuffer(raw, ">u8")[::4]
                        among = np.flatnonzero(left) if i < len(names) and left.any() else np.arange(len(names))
                        near = key[among]
                        least = among[near == near.min()]
                        picks[i] = least[0] if len(least) == 1 else min(least.tolist(), key=lambda at: raw[32 * at : 32 * at + 32])
                        left[picks[i]] = False
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(picks), r, np.int32)), t.field("id"), c.field("id").take(pa.array(picks))], names=["replicate", "target_id", "control_id"])

    dealt = tasks.select("_from", "_step", "_targets", "_controls").repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = dealt.mapInArrow(each, f"replicate int, target_id {kind['target_id']}, control_id {kind['control_id']}")
    large = sizes.where(F.col("_pairs") > WHOLE)
    return done.unionByName(by_pairs(targets.join(large.select(*own), own))) if large.limit(1).count() else done


def _least_hashed(tasks: DataFrame, seed: str) -> DataFrame:
    """(target_id, replicate, _list, _size): the `_depth` controls of least hash(seed, replicate, target, control) for each of the replicates `_in`, in order, and the size of the pool."""
    kind = {f.name: f.dataType for f in tasks.schema}
    one = kind["_pool"].elementType["control_id"].dataType.simpleString()
    named = tasks.withColumn("_name", F.col("target_id").cast("string"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            for k in range(b.num_rows):
                pool = b.column("_pool").slice(k, 1).flatten()
                names = [x.encode() for x in pool.field("name").to_pylist()]
                own, depth, chosen = b.column("_in")[k].as_py(), min(b.column("_depth")[k].as_py(), len(pool)), []
                for r in own:
                    head = f"{seed}|{r}|{b.column('_name')[k].as_py()}|".encode()
                    digests = [sha(head + x).digest() for x in names]
                    key = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
                    near = np.flatnonzero(key <= np.partition(key, depth - 1)[depth - 1])
                    chosen.append(np.array(sorted(near.tolist(), key=digests.__getitem__)[:depth]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * depth, pa.int32()), pool.field("control_id").take(pa.array(np.concatenate(chosen))))
                target = b.column("target_id").take(pa.array(np.full(len(own), k)))
                yield pa.RecordBatch.from_arrays([target, pa.array(own, pa.int32()), lists, pa.array([len(pool)] * len(own), pa.int32())], names=["target_id", "replicate", "_list", "_size"])

    dealt = named.repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(least, f"target_id {kind['target_id'].simpleString()}, replicate int, _list array<{one}>, _size int")


def _totals(values: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Counts and sums of values by label 1 and 0; rows without a value or label count for neither."""
    one, zero = labels == 1, labels == 0
    ok = ~np.isnan(values)
    return {"n1": (one & ok).sum(), "s1": values[one & ok].sum(), "n0": (zero & ok).sum(), "s0": values[zero & ok].sum()}


_TOTALS = "n1 long, s1 double, n0 long, s0 double"


def _row_totals(df: DataFrame, label: str, value: str, by: Sequence[str]) -> DataFrame:
    y, x = F.col(label), F.col(value).cast("double")
    one, zero = (y == 1) & x.isNotNull(), (y == 0) & x.isNotNull()
    zeros = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(F.count_if(one).alias("n1"), zeros(F.sum(F.when(one, x))).alias("s1"), F.count_if(zero).alias("n0"), zeros(F.sum(F.when(zero, x))).alias("s0"))


def permutation_totals(df: DataFrame, strata: Sequence[str], ident: str, label: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, n1, s1, n0, s0): counts and sums of `value` by permuted label, labels being permuted within strata."""
    each = permuted(df, strata, ident, [label, value], replicates, seed, lambda a, order: {k: np.array([v]) for k, v in _totals(a[value][order], a[label]).items()}, _TOTALS)
    large = large_strata(df, strata)
    if large is not None:
        drawn = permuted_labels(large, strata, ident, label, replicates, seed)
        met = met_on(drawn, large.select(*strata, ident, value), [*strata, ident])
        each = each.unionByName(_row_totals(met, "permuted", value, ["replicate"]).withColumn("replicate", F.col("replicate").cast("long")))
    return each.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n1", "s1", "n0", "s0")])


def mean_gap() -> Column:
    """Difference of the two classes' means from totals; null if a class is empty."""
    return F.try_divide("s1", "n1") - F.try_divide("s0", "n0")


def permuted_term_counts(df: DataFrame, strata: Sequence[str], ident: str, term: str, label: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, term, k, drawn): rows of each term, and how many of them carry label 1 after permuting labels within strata. `term` is a number."""

    def count(a, order):
        names, at = np.unique(a[term][order], return_inverse=True)
        return {"_term": names, "k": np.bincount(at, weights=a[label], minlength=len(names)), "drawn": np.bincount(at, minlength=len(names))}

    each = permuted(df, strata, ident, [term, label], replicates, seed, count, "_term double, k double, drawn long").select("replicate", F.col("_term").cast(df.schema[term].dataType).alias(term), F.col("k").cast("long").alias("k"), "drawn")
    large = large_strata(df, strata)
    if large is not None:
        drawn = permuted_labels(large, strata, ident, label, replicates, seed)
        met = met_on(drawn, large.select(*strata, ident, term), [*strata, ident])
        each = each.unionByName(met.groupBy(F.col("replicate").cast("long").alias("replicate"), term).agg(F.sum("permuted").cast("long").alias("k"), F.count(F.lit(1)).alias("drawn")))
    return each.groupBy("replicate", term).agg(F.sum("k").alias("k"), F.sum("drawn").alias("drawn"))


def chosen_sums(df: DataFrame, strata: Sequence[str], ident: str, label: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, chosen, total): in each replicate as many rows of a stratum are chosen as carry the label, those with the smallest hash; their count and sum of `value`."""

    def first(a, order):
        held = a[value][order[: int(a[label].sum())]]
        return {"chosen": np.array([len(held)]), "total": np.array([np.nansum(held)])}

    each = permuted(df, strata, ident, list(dict.fromkeys([label, value])), replicates, seed, first, "chosen long, total double")
    large = large_strata(df, strata)
    if large is not None:
        met = met_on(chosen_labels(large, strata, ident, label, replicates, seed), large.select(*strata, F.col(ident).alias("_same"), F.col(value).cast("double").alias("_v")).withColumnRenamed("_same", ident), [*strata, ident])
        each = each.unionByName(met.groupBy(F.col("replicate").cast("long").alias("replicate")).agg(F.count(F.lit(1)).alias("chosen"), F.sum("_v").alias("total")))
    return each.groupBy("replicate").agg(F.sum("chosen").alias("chosen"), F.sum("total").alias("total"))


def permutation_jackknife(df: DataFrame, block: str, strata: Sequence[str], ident: str, label: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(left_out, observed, p): with each block left out in turn, labels are permuted within strata and the difference of the two classes' means is compared.

    The place of a row by hash is the same in every subset up to what is left out, so one
    order of a stratum serves all blocks, and a subset takes its own places from it.
    """
    blocks = df.select(F.col(block).alias("left_out")).distinct()
    numbered = row_numbers(blocks, [], ["left_out"], "_b")
    rows = met_on(df.select(*dict.fromkeys([block, *strata, ident, label, value])), numbered.withColumnRenamed("left_out", block), [block])
    by_block = _row_totals(rows, label, value, ["_b"])
    whole = by_block.agg(*[F.sum(c).alias(f"_{c}") for c in ("n1", "s1", "n0", "s0")])
    rest = by_block.join(F.broadcast(whole)).select("_b", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in ("n1", "s1", "n0", "s0")])
    observed = rest.select("_b", mean_gap().alias("observed"))

    def each_block(a, order):
        own, out = a["_b"], {"_left": [], "n1": [], "s1": [], "n0": [], "s0": []}
        ordered, labels, values = own[order], a[label], a[value][order]
        for b in np.unique(own):
            out["_left"].append(int(b))
            for k, v in _totals(values[ordered != b], labels[own != b]).items():
                out[k].append(v)
        return out

    null = permuted(rows, strata, ident, ["_b", label, value], replicates, seed, each_block, f"_left long, {_TOTALS}")
    # in strata without a row of a block nothing is left out: their totals count for that block as they are
    if strata:
        held = rows.select(*strata, "_b").distinct()
        every = rows.select(*strata).distinct().crossJoin(F.broadcast(numbered.select("_b")))
        absent = met_on(every, held, [*strata, "_b"], "left_anti")
        same = permuted(met_on(rows.drop("_b"), absent, list(strata)), [*strata, "_b"], ident, ["_b", label, value], replicates, seed, lambda a, order: {"_left": np.array([int(a["_b"][0])]), **{k: np.array([v]) for k, v in _totals(a[value][order], a[label]).items()}}, f"_left long, {_TOTALS}")
        null = null.unionByName(same)
    large = large_strata(rows, strata)
    if large is not None:
        names = numbered.select("_b").withColumnRenamed("_b", "_left")
        others = large.join(F.broadcast(names), F.col("_b") != F.col("_left"))
        drawn = permuted_labels(others, ["_left", *strata], ident, label, replicates, seed)
        null = null.unionByName(_row_totals(met_on(drawn, others.select("_left", *strata, ident, value), ["_left", *strata, ident]), "permuted", value, ["_left", "replicate"]).withColumns({"replicate": F.col("replicate").cast("long"), "_left": F.col("_left").cast("long")}))
    t = null.groupBy(F.col("_left").alias("_b"), "replicate").agg(*[F.sum(c).alias(c) for c in ("n1", "s1", "n0", "s0")]).select("_b", "replicate", mean_gap().alias("_t"))
    p = t.join(observed, "_b").groupBy("_b").agg(F.max("observed").alias("observed"), empirical_p(F.round("_t", 9), F.round("observed", 9)).alias("p"))
    return p.join(numbered, "_b").select("left_out", "observed", "p")


def leave_one_out_enrichment(df: DataFrame, block: str, term: str, marked: str) -> DataFrame:
    """(left_out, term, k, drawn, marked, total) with each block left out in turn, from counts by block."""
    cells = df.groupBy(block, term).agg(F.count(F.lit(1)).alias("n"), F.sum(marked).alias("m"))
    by_block = cells.groupBy(block).agg(F.sum("n").alias("bn"), F.sum("m").alias("bm"))
    by_term = cells.groupBy(term).agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    whole = by_block.agg(F.sum("bn").alias("an"), F.sum("bm").alias("am"))
    every = by_block.join(by_term, how="cross").join(F.broadcast(whole)).join(cells, [block, term], "left").na.fill({"n": 0, "m": 0})
    return every.select(F.col(block).alias("left_out"), term, (F.col("tm") - F.col("m")).alias("k"), (F.col("tn") - F.col("n")).alias("drawn"), (F.col("am") - F.col("bm")).alias("marked"), (F.col("an") - F.col("bn")).alias("total"))
