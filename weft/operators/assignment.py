"""Matching that has to look at rows one after another.

Rows are first split into parts that cannot touch each other: stretches of a stratum
without a gap as wide as the caliper, or connected components of the pairs that score.
Each part is solved by itself within one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.operators.graph import components
from weft.operators.ordered import met_on, running_max_before, running_sums

#: Meetings of a family's genes on an item up to which they are joined as rows; the genes of larger families travel and meet in tasks.
JOINED = 1 << 12


def greedy_pairs(targets: DataFrame, pool: DataFrame, strata: Sequence[str], value: str, caliper: float | None = None) -> DataFrame:
    """(strata, target_id, control_id, distance): each target in order of id takes the nearest control left in its stratum, ties by id.

    `targets` has target_id and `pool` control_id. A control serves once; a row whose value
    is null or not finite matches nothing. A stratum is cut into parts that cannot touch
    each other, which changes no match: with a caliper, where the sorted values leave a gap
    wider than that; without one, at controls that no target can reach (`_apart`). Only
    controls that may be taken go to Python, where a target costs two look-ups; a part is
    held whole, and is large only where targets outnumber the values of the controls
    around them.
    """
    strata = list(strata)
    finite = F.abs(F.col(value).cast("double")) < float("inf")
    targets, pool = targets.where(finite), pool.where(finite)
    if caliper is None:
        parts = _apart(targets, pool, strata, value)
    else:
        points = targets.select(*strata, value).union(pool.select(*strata, value)).distinct()
        gaps = running_max_before(points, strata, [value], value, "_before")
        parts = checkpoint(running_sums(gaps, strata, [value], {"_part": F.when(F.col(value) - F.col("_before") > caliper, 1).otherwise(0)}).drop("_before"))
    targets, pool = met_on(targets, parts, [*strata, value]), met_on(pool, parts, [*strata, value])
    return _greedy(targets, pool, [*strata, "_part"], value, float("inf") if caliper is None else caliper).drop("_part")


def _apart(targets: DataFrame, pool: DataFrame, strata: list[str], value: str) -> DataFrame:
    """(strata, value, _part) of the values that greedy matching may touch.

    A control that stays free is never passed over, so a stretch of neighbouring control
    values that all lose a control has at least as many targets between its free
    neighbours as it has values. With f the running count of targets less that of control
    values, a value is in such a stretch only if f reaches, from there on, its least value
    before there (or zero). All others stay free and part the stratum.
    """
    asked = targets.select(*strata, value, F.lit(1).alias("_asks"), F.lit(0).alias("_has"))
    points = asked.union(pool.select(*strata, value, F.lit(0), F.lit(1))).groupBy(*strata, value).agg(F.sum("_asks").alias("_asks"), F.max("_has").alias("_has"))
    f = running_sums(points, strata, [value], {"_f": F.col("_asks") - F.col("_has")})
    low = running_max_before(f.withColumn("_down", -F.col("_f")), strata, [value], "_down", "_before")
    high = running_max_before(low, strata, [F.desc(value)], "_f", "_after")
    reached = F.greatest("_f", "_after") >= F.least(F.lit(0), -F.col("_before"))  # nulls at the ends are skipped
    marked = high.select(*strata, value, ((F.col("_has") == 0) | reached).alias("_open"))
    parts = running_sums(marked, strata, [value], {"_part": F.when(F.col("_open"), 0).otherwise(1)})
    return checkpoint(parts.where("_open").drop("_open"))


def nearest_free(asked: np.ndarray, x: np.ndarray, ids: Sequence, caliper: float = float("inf")) -> list[int]:
    """For each value of `asked` in turn the place in `x` of the nearest entry still free, ties by id, or -1.

    `x` is sorted, equal values by id. Values without a free entry are skipped by links to
    the next one on either side, which are shortened as they are followed.
    """
    values, head = np.unique(x, return_index=True)
    n, last, head = len(values), [*head[1:].tolist(), len(x)], head.tolist()
    down, up = list(range(n + 1)), list(range(n + 2))  # values count from 1; 0 and n + 1 lie beyond

    def follow(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    out, points = [], values.tolist()
    for v, at in zip(asked.tolist(), np.searchsorted(values, asked, side="right").tolist(), strict=True):
        left, right = follow(down, at), follow(up, at + 1)
        to_left = v - points[left - 1] if left else float("inf")
        to_right = points[right - 1] - v if right <= n else float("inf")
        if min(to_left, to_right) > caliper or (left == 0 and right > n):
            out.append(-1)
            continue
        first = to_left < to_right or (to_left == to_right and ids[head[left - 1]] < ids[head[right - 1]])
        k = left if first else right
        out.append(head[k - 1])
        head[k - 1] += 1
        if head[k - 1] == last[k - 1]:
            down[k], up[k] = k - 1, k + 1
    return out


def _greedy(targets: DataFrame, pool: DataFrame, strata: list[str], value: str, caliper: float) -> DataFrame:
    """Parts pass a task one after another as sorted rows, so that many small ones cost no call each; none but the one at hand is held."""
    kinds, control = dict(targets.dtypes), dict(pool.dtypes)["control_id"]
    x = F.col(value).cast("double").alias("_x")
    rows = targets.select(*strata, "target_id", F.lit(None).cast(control).alias("control_id"), x, F.lit(True).alias("_asks"))
    rows = rows.union(pool.select(*strata, F.lit(None).cast(kinds["target_id"]), "control_id", x, F.lit(False)))
    # little data may be much work: the number of partitions is given, so that Spark does not merge them by size
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *strata)
    # controls by value and id, then targets by id and value
    order = ["_asks", F.col("target_id").asc_nulls_last(), "_x", F.col("control_id").asc_nulls_last()]
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))

    def matched(t: pa.Table) -> pa.RecordBatch:
        """The matches of whole parts."""
        x, asks, ids = t["_x"].to_numpy(), t["_asks"].to_numpy(), t["control_id"].to_pylist()
        if t["control_id"].null_count:
            ids = [(i is None, i) for i in ids]
        begins = np.flatnonzero(t["_at"].to_numpy() == 1)
        out, taken = [], []
        for i, k, j in zip(begins.tolist(), (begins + np.add.reduceat(~asks, begins, dtype=np.int64)).tolist(), [*begins[1:].tolist(), t.num_rows], strict=True):
            if i < k < j:
                for at, place in enumerate(nearest_free(x[k:j], x[i:k], ids[i:k], caliper), k):
                    if place >= 0:
                        out.append(at)
                        taken.append(i + place)
        asked, given = t.take(pa.array(out, pa.int64())), t["control_id"].take(pa.array(taken, pa.int64()))
        found = pa.table([*[asked[c] for c in (*strata, "target_id")], given, np.abs(x[taken] - x[out]) if out else pa.array([], pa.float64())], names=[*strata, "target_id", "control_id", "distance"])
        return found.combine_chunks()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            begins = np.flatnonzero(b.column("_at").to_numpy() == 1)
            if len(begins) and (begins[-1] or held):
                whole = pa.Table.from_batches([*held, b.slice(0, begins[-1])])
                held = []
                yield from matched(whole).to_batches()
                b = b.slice(begins[-1])
            held.append(b)
        if held:
            yield from matched(pa.Table.from_batches(held)).to_batches()

    schema = ", ".join([f"`{s}` {kinds[s]}" for s in strata] + [f"target_id {kinds['target_id']}", f"control_id {control}", "distance double"])
    return rows.mapInArrow(each, schema)


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one assignment with the largest total gain; shortest augmenting paths with potentials."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            slack = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (slack < low[1:])
            low[1:][better], back[1:][better] = slack[better], j0
            j1 = 1 + int(np.where(used[1:], np.inf, low[1:]).argmin())
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def best_transport(gain: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, column, n) with the largest total of n times gain, where a row serves `supply` and a column `demand` times; best augmenting paths, each as often as it has room."""
    if supply.sum() <= 2 * len(supply) and demand.sum() <= 2 * len(demand):  # few repeats: single ones are matched, which takes no search over the whole matrix
        rows, cols = np.repeat(np.arange(len(supply)), supply), np.repeat(np.arange(len(demand)), demand)
        taken = Counter((int(rows[i]), int(cols[j])) for i, j in best_assignment(gain if len(rows) == len(supply) and len(cols) == len(demand) else gain[np.ix_(rows, cols)]))
        return [(i, j, n) for (i, j), n in taken.items()]
    flow, supply, demand = np.zeros(gain.shape, np.int64), supply.astype(np.int64), demand.astype(np.int64)
    every, tiny = np.arange(gain.shape[1]), 1e-12
    while True:
        row, row_from = np.where(supply > 0, 0.0, -np.inf), np.full(gain.shape[0], -1)
        col, col_from = np.full(gain.shape[1], -np.inf), np.full(gain.shape[1], -1)
        while True:
            over = row[:, None] + gain
            at = over.argmax(0)
            better = over[at, every] > col + tiny
            if not better.any():
                break
            col[better], col_from[better] = over[at, every][better], at[better]
            back = np.where(flow > 0, col[None, :] - gain, -np.inf)
            at = back.argmax(1)
            value = back[np.arange(len(at)), at]
            better = value > row + tiny
            row[better], row_from[better] = value[better], at[better]
        open_ = np.where(demand > 0, col, -np.inf)
        j = int(open_.argmax())
        if open_[j] <= tiny:
            return [(int(i), int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow))]
        path, end = [], j
        while True:
            i = int(col_from[j])
            path.append((i, j, 1))
            if row_from[i] < 0:
                break
            j = int(row_from[i])
            path.append((i, j, -1))
        n = min(int(supply[i]), int(demand[end]), *(int(flow[i, j]) for i, j, sign in path if sign < 0))
        for k, j, sign in path:
            flow[k, j] += sign * n
        supply[i] -= n
        demand[end] -= n


def optimal_pairs(scores: DataFrame, group: Sequence[str], left: str, right: str, score: str, times: tuple[str, str] | None = None) -> DataFrame:
    """(group, left, right, score): the one-to-one assignment with the largest total in each group; pairs that are absent or score zero or less are not returned.

    A group is solved by connected components of its scoring pairs, which is the same: no
    pair joins two of them. `times` names two columns of how many equal ones the left and
    the right stand for; then a column `n` tells how often a pair is taken.
    """
    group = list(group)
    kinds = dict(scores.dtypes)
    node = lambda side, c: F.xxhash64(F.lit(side), *group, c)
    scores = checkpoint(scores.where(F.col(score) > 0).withColumn("_u", node("left", left)))
    of = components(scores.select(F.col("_u").alias("u"), node("right", right).alias("v")))
    scores = scores.join(of.withColumnRenamed("node", "_u"), "_u").withColumnRenamed("component", "_part")
    columns = [*group, left, right, score, *(["n"] if times else [])]

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        key = key[:-1]
        m = g.pivot_table(index=left, columns=right, values=score, aggfunc="max", fill_value=0.0)
        gain = m.to_numpy(float)
        if times:
            room = [g.groupby(side)[name].max().loc[labels].to_numpy() for side, name, labels in ((left, times[0], m.index), (right, times[1], m.columns))]
            pairs = [(*key, m.index[i], m.columns[j], float(gain[i, j]), n) for i, j, n in best_transport(gain, *room) if gain[i, j] > 0]
        else:
            pairs = [(*key, m.index[i], m.columns[j], float(gain[i, j])) for i, j in best_assignment(gain) if gain[i, j] > 0]
        return pd.DataFrame(pairs, columns=columns)

    # a few components are much work: the number of partitions is given, so that Spark does not merge them by size
    dealt = scores.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "_part")
    return dealt.groupBy(*group, "_part").applyInPandas(one, ", ".join([f"`{c}` {kinds[c]}" for c in (*group, left, right)] + [f"`{score}` double"] + (["n long"] if times else [])))


def lcs_share():
    """Column function (a, b) of arrays: length of the longest common subsequence over the longer length."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if not len(x) or not len(y):
                return 0.0
            codes = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
            p, q = np.array([codes[t] for t in x]), np.array([codes[t] for t in y])
            row = np.zeros(len(q) + 1, int)
            for t in p:  # a new row is the running maximum of the old one and its diagonal steps
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(q == t, row[:-1] + 1, 0)))
            return float(row[-1]) / max(len(p), len(q))

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return share


def synteny_score(windows: DataFrame, pairs: DataFrame, ident: str, window: str) -> DataFrame:
    """pairs (a, b, ...) with jaccard, lcs (the better of both orders) and their mean as score."""
    w = windows.select(ident, window)
    met = pairs.join(w.select(F.col(ident).alias("a"), F.col(window).alias("_wa")), "a").join(w.select(F.col(ident).alias("b"), F.col(window).alias("_wb")), "b")
    lcs = lcs_share()
    jaccard: Column = F.coalesce(F.try_divide(F.size(F.array_intersect("_wa", "_wb")), F.size(F.array_union("_wa", "_wb"))), F.lit(0.0))
    scored = met.withColumn("jaccard", jaccard).withColumn("lcs", F.greatest(lcs("_wa", "_wb"), lcs("_wa", F.reverse("_wb"))))
    return scored.withColumn("score", (F.col("jaccard") + F.col("lcs")) / 2).drop("_wa", "_wb")


def _parts(gene: np.ndarray, item: np.ndarray, genes: int, items: int) -> np.ndarray:
    """For each gene the smallest gene that it is connected to by items."""
    part = np.arange(genes)
    while True:
        low, to = np.full(items, genes), part.copy()
        np.minimum.at(low, item, part[gene])
        np.minimum.at(to, part[gene], low[item])
        while (to[to] != to).any():
            to = to[to]
        if (to == part).all():
            return part
        part = to


def _pairs_of_windows(genes: DataFrame, family: list[str]) -> DataFrame:
    """optimal_pairs by Jaccard similarity of (family, side, id, window, n) without a row for each pair: a component's windows travel as numbers of items, and its task counts what they share by a product of matrices."""
    kinds = dict(genes.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in family)

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left, windows = t.column("side").to_numpy(zero_copy_only=False) == "left", t.column("window").combine_chunks()
        code = windows.flatten().dictionary_encode().indices.fill_null(-1).to_numpy()
        code, items = code + 1, int(code.max(initial=-1)) + 2
        gene, item = np.divmod(np.unique(np.repeat(np.arange(len(left)), np.diff(windows.offsets.to_numpy())) * items + code), items)
        size = np.bincount(gene, minlength=len(left))
        both = np.isin(np.arange(items), item[left[gene]]) & np.isin(np.arange(items), item[~left[gene]])
        both[0] = False  # nulls, which a window has as an item and no two genes meet on
        gene, item = gene[both[item]], item[both[item]]
        part = _parts(gene, item, len(left), items)
        held = np.unique(gene)
        order = held[np.lexsort((held, part[held]))]
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        place = np.empty(len(left), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[gene], kind="stable")
        has = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(place[gene], minlength=len(order)))]), pa.int32()), pa.array(item[by], pa.int32()))
        picked = pa.array(order)
        rows = pa.StructArray.from_arrays([pa.array(left[order]), t.column("id").combine_chunks().take(picked), t.column("n").combine_chunks().take(picked), pa.array(size[order], pa.int32()), has], names=["left", "id", "n", "size", "has"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), rows)
        return pa.table([*[pa.repeat(k, len(lists)) for k in key], lists], names=[*family, "_genes"])

    parts = genes.groupBy(*family).applyInArrow(cut, f"{named}, _genes array<struct<left: boolean, id: {kinds['id']}, n: long, size: int, has: array<int>>>")
    dealt = parts.repartition(int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                g = batch.column("_genes").slice(r, 1).flatten()
                left, ids, n, size, has = (g.field(c) for c in ("left", "id", "n", "size", "has"))
                left, n, size = (x.to_numpy(zero_copy_only=False) for x in (left, n, size))
                code = np.unique(has.flatten().to_numpy(), return_inverse=True)[1]
                member = np.zeros((len(left), code.max() + 1), np.float32)
                member[np.repeat(np.arange(len(left)), np.diff(has.offsets.to_numpy())), code] = 1
                a, b = np.flatnonzero(left), np.flatnonzero(~left)
                gain = (member[a] @ member[b].T).astype(float)
                gain /= size[a][:, None] + size[b] - gain
                i, j, taken = (np.array(x, np.int64) for x in zip(*[(i, j, k) for i, j, k in best_transport(gain, n[a], n[b]) if gain[i, j] > 0]))
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[r], len(i)) for c in family], ids.take(pa.array(a[i])), ids.take(pa.array(b[j])), pa.array(gain[i, j]), pa.array(taken)], names=[*family, "a", "b", "jaccard", "n"])

    return dealt.mapInArrow(solve, f"{named}, a {kinds['id']}, b {kinds['id']}, jaccard double, n long")


def family_synteny(genes: DataFrame, family: Sequence[str]) -> DataFrame:
    """(family, n_left, n_right, jaccard, lcs): the neighbourhoods of a family's genes on two sides, matched one to one for the largest total Jaccard similarity and divided by the larger side.

    `genes` is (id, family, side left or right, window: the neighbours' names in order).
    Only genes that share a neighbour meet, through it; all others have similarity zero and
    add nothing, as genes that stay unmatched do. Genes of a side with the same window are
    matched as one with their number. A family whose genes meet more than JOINED times has
    its genes sent to tasks by connected component, and no pair of them is written.
    `lcs` is the mean of the matched pairs' share of common order, the better of both
    strands.
    """
    family = list(family)
    sized = genes.groupBy(*family).agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right")).where("n_left > 0 AND n_right > 0")
    kept = genes.join(sized.select(*family), family).groupBy(*family, "side", "window").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    kept = checkpoint(kept)
    item = kept.select(*family, "side", "id", F.explode(F.array_distinct("window")).alias("_item"))
    on = lambda which: F.count_if(F.col("side") == which)
    meets = item.groupBy(*family, "_item").agg((on("left") * on("right")).alias("_m")).groupBy(*family).agg(F.sum("_m").alias("_m"))
    large = checkpoint(meets.where(F.col("_m") > JOINED).select(*family))
    item = item.join(large, family, "left_anti")
    side = lambda which, name: item.where(F.col("side") == which).select(*family, "_item", F.col("id").alias(name))
    shared = side("left", "a").join(side("right", "b"), [*family, "_item"]).groupBy(*family, "a", "b").agg(F.count(F.lit(1)).alias("_k"))
    size = lambda name, n: kept.select(F.col("id").alias(name), F.size(F.array_distinct("window")).alias(f"_size_{name}"), F.col("n").alias(n))
    scored = shared.join(size("a", "_na"), "a").join(size("b", "_nb"), "b").withColumn("jaccard", F.col("_k") / (F.col("_size_a") + F.col("_size_b") - F.col("_k")))
    taken = optimal_pairs(scored.select(*family, "a", "b", "jaccard", "_na", "_nb"), family, "a", "b", "jaccard", ("_na", "_nb"))
    taken = taken.unionByName(_pairs_of_windows(kept.join(large, family, "left_semi"), family))
    chosen = synteny_score(kept.select("id", "window"), taken.drop("jaccard"), "id", "window")
    total = chosen.groupBy(*family).agg(F.sum(F.col("n") * F.col("jaccard")).alias("_j"), F.sum(F.col("n") * F.col("lcs")).alias("_l"))
    over = F.greatest("n_left", "n_right")
    return sized.join(total, family, "left").select(*family, "n_left", "n_right", (F.coalesce("_j", F.lit(0.0)) / over).alias("jaccard"), (F.coalesce("_l", F.lit(0.0)) / over).alias("lcs"))
