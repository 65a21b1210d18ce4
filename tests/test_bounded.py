"""Steps whose pairs grow with the product of two sides hand on what grows with the sides."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import assignment, graph, relational, replicates, resampling


@pytest.mark.parametrize("alphabet", [8, 40])
def test_genes_of_large_families_meet_in_tasks(spark, monkeypatch, alphabet):
    """No pair of genes is made a row; totals are those of all pairs, also with equal windows, null items, and families in one piece or in many."""
    rng = np.random.default_rng(alphabet)
    names = [None, *(f"i{k}" for k in range(alphabet))]
    windows = [[names[int(k)] for k in rng.integers(0, len(names), rng.integers(0, 4))] for _ in range(60)]
    genes = [(i, f"f{i % 2}", "left" if rng.random() < 0.4 else "right", windows[int(rng.integers(0, 60))]) for i in range(140)] + [(900, "f3", "left", ["i1"]), (901, None, "left", ["i1"]), (902, None, "right", ["i1"])]
    df = spark.createDataFrame(genes, "id long, family string, side string, window array<string>")
    columns = lambda x: {r.family: (r.n_left, r.n_right, r.jaccard) for r in x.select("family", "n_left", "n_right", "jaccard").collect()}
    monkeypatch.setattr(assignment, "JOINED", 1 << 40)
    want = columns(assignment.family_synteny(df, ["family"]))
    monkeypatch.setattr(assignment, "JOINED", 0)
    joined = []
    monkeypatch.setattr(assignment, "optimal_pairs", lambda s, *a, f=assignment.optimal_pairs: joined.append(s.count()) or f(s, *a))
    got = columns(assignment.family_synteny(df, ["family"]))
    assert joined == [0] and {"f0", "f1"} <= set(got) == set(want)
    assert all(got[f][:2] == want[f][:2] and got[f][2] == pytest.approx(want[f][2]) and (f is None or want[f][2] > 0) for f in want)


@pytest.mark.parametrize("whole, twice", [(1 << 28, False), (30, False), (0, False), (1 << 28, True)])
def test_pools_of_strata_are_not_written_as_pairs(spark, monkeypatch, whole, twice):
    """The assignment is that of all pairs, with strata that run out of controls, without any, and with null keys."""
    targets = [(i % 4, "ab"[i % 2], i) for i in range(37)] + [(9, "a", 100), (None, "a", 101)] + ([(1, "a", 0)] if twice else [])
    controls = [(i % 4, "ab"[i % 2], 500 + i) for i in range(29)] + [(8, "a", 600), (None, "a", 601)]
    t = spark.createDataFrame(targets, "k int, m string, target_id long")
    c = spark.createDataFrame(controls, "k int, m string, control_id long")
    rows = lambda df: sorted(map(tuple, df.select("replicate", "target_id", "control_id").collect()))
    want = rows(resampling.assigned_controls(t.join(c, ["k", "m"]).select("target_id", "control_id"), 7, "w"))
    pairs = []
    monkeypatch.setattr(resampling, "assigned_controls", lambda p, *a, f=resampling.assigned_controls: pairs.append(p.count()) or f(p, *a))
    monkeypatch.setattr(resampling, "WHOLE", whole)
    monkeypatch.setattr(resampling, "HASHES", 40)
    assert rows(resampling.assigned_controls_within(t, c, ["k", "m"], 7, "w")) == want and len(want) > 200
    assert bool(pairs) == (twice or whole < 1 << 28)


@pytest.mark.parametrize("side", [6, 1 << 15])
def test_pairs_within_a_caliper_are_counted_not_made(spark, monkeypatch, side):
    """With ties at the last place, targets that are controls too, equal values by the dozen, nulls, and bins in several parts."""
    monkeypatch.setattr(relational, "SIDE", side)
    rng = np.random.default_rng(side)
    t = [(i, i % 2, float(rng.integers(0, 60)) / 4) for i in range(40)] + [(90, 0, None), (91, 0, float("nan")), (92, 1, 500.0)]
    p = [(i, i % 2, float(rng.integers(0, 60)) / 4) for i in range(20, 160)] + [(i, 0, 7.25) for i in range(200, 240)] + [(300, 0, None), (301, 0, float("inf")), (30, 0, 1.0), (30, 0, 1.25)]
    tie = F.sha2(F.concat_ws("|", F.col("target_id").cast("string"), F.col("control_id").cast("string"), F.col("y").cast("string")), 256)
    made = []
    monkeypatch.setattr(relational, "_nearest_within", lambda *a, f=relational._nearest_within: made.append(f(*a)) or made[-1])
    got = relational.staged_match(spark.createDataFrame(t, "target_id long, k int, x double"), spark.createDataFrame(p, "control_id long, k int, y double"), ["k"], "x", "y", [0.3, 1, 4], 6, 5, tie)
    want = []
    for i, k, x in t:
        for stage, limit in enumerate((0.3, 1, 4), 1):
            near = [(abs(x - y), hashlib.sha256(f"{i}|{c}|{y}".encode()).hexdigest(), c) for c, b, y in p if x is not None and y is not None and b == k and c != i and abs(x - y) <= limit]
            if len(near) >= 6:
                want += [(i, c, stage, len(near), n) for n, (_, _, c) in enumerate(sorted(near)[:5], 1)]
                break
    assert sorted(map(tuple, got.select("target_id", "control_id", "stage", "pool_size", "place").collect())) == sorted(want) and {w[2] for w in want} == {1, 2, 3}
    n, pairs = zip(*(m.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first() for m in made))
    assert side < 10 or sum(n) < sum(pairs)


@pytest.mark.parametrize("widths", [(0.0, 60.0, float("inf")), (6.0, 60.0, float("inf"))])
def test_medians_need_no_vector_for_each_row(spark, monkeypatch, widths):
    """Also where a band misses the middle rows, with nulls, a group of nulls, and equal values."""
    monkeypatch.setattr(replicates, "WIDTHS", widths)
    rng = np.random.default_rng(3)
    rows = [("abc"[i % 3], i, None if i % 11 == 0 else float(rng.integers(0, 400)) + (i % 3) * 300) for i in range(900)] + [("d", i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    medians = lambda: {r.replicate: r.median for r in resampling.hierarchical_median(df, "g", "id", "v", 40, "m").collect()}
    monkeypatch.setattr(replicates, "DRAWN", 0)
    want = medians()
    monkeypatch.setattr(replicates, "DRAWN", 1 << 21)
    monkeypatch.setattr(resampling, "drawn_weights", None)
    assert medians() == want and len(want) == 39  # one draws the group of nulls only


@pytest.mark.parametrize("drawn", [0, 30, 1 << 21])
def test_sums_of_draws_need_no_vector_for_each_row(spark, monkeypatch, drawn):
    """Strata of any size, null ones, and several rows of a block."""
    monkeypatch.setattr(replicates, "DRAWN", drawn)
    df = spark.createDataFrame([(None if i % 7 == 0 else "ab"[i % 3 // 2], i // 2, float(i % 13)) for i in range(120)], "g string, id long, x double")
    sums = {"n": F.lit(1), "s": F.col("x")}
    for own in ([], ["g"]):
        vectors = replicates.replicate_sums(df, [(replicates.drawn_weights(df, "id", 30, "n", own), [*own, "id"])], 30, sums)
        want = {r.replicate: (r.n, r.s) for r in vectors.collect()}
        got = {r.replicate: (r.n, r.s) for r in replicates.drawn_sums(df, "id", 30, "n", sums, own).collect()}
        assert got == want and len(got) == 30  # whole numbers, so sums are exact


def test_a_forest_of_blocks_makes_no_pairs(spark, monkeypatch):
    """Forests of blocks with outliers, ties and parts that share nothing; and the query's step makes no pair but those it returns."""
    rng = np.random.default_rng(6)
    for k in range(60):
        n, m = (int(x) for x in rng.integers(1, 40, 2))
        w = rng.integers(0 if k % 2 else 1, 4 + k, (n, m)) / 60
        w[rng.random((n, m)) < k % 3 * 0.4] = 0
        same = k % 4 == 0
        w = np.triu(rng.integers(0, 4 + k, (n, n)) / 60, 1) if same else w
        i, j = np.nonzero(w)
        want = graph.forest_of(i, j if same else j + n, w[i, j]) if len(i) else []
        got = graph._forest_of_pairs(w + w.T if same else w, same)
        assert {*zip(*(x.tolist() for x in got))} == {(int(i[x]), int(j[x])) for x in want}
    monkeypatch.setattr(graph, "SIDE", 9)
    rows = [(s, int(x)) for s in range(50) for x in np.flatnonzero(rng.random(12) < (0.15 if s % 17 == 0 else 0.8))] + [(60, 77), (61, 77)]
    df = spark.createDataFrame(rows, "id long, item int")
    want = {tuple(r) for r in graph.spanning_edges(graph.shared_jaccard(df, "id", "item"), "jaccard", 0.9).collect()}
    monkeypatch.setattr(graph, "_jaccard_of_blocks", None)
    made = []
    monkeypatch.setattr(graph, "spanning_edges", lambda e, *a, f=graph.spanning_edges: made.append(e.count()) or f(e, *a))
    assert {tuple(r) for r in graph.jaccard_spanning_edges(df, "id", "item", 0.9).collect()} == want and len(want) > 49
    assert made[0] < 900
