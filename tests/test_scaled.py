"""Tables whose keys, sizes or estimates differ from the smallest ones."""

import hashlib
import sys
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import __spark_entry__  # noqa: E402
from compare import rows  # noqa: E402

from weft.functions import sequence  # noqa: E402
from weft.operators import assignment, graph, relational, replicates, resampling, shuffles  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def test_patristic_where_suppliers_and_nations_share_keys(spark, tmp_path):
    """Supplier 1001 is not nation 1, nor supplier 2001 region 1."""
    keys = np.r_[1000:1040, 1998:2012]
    pd.DataFrame({"s_suppkey": keys, "s_nationkey": np.where(keys < 1024, (keys + 1) % 25, 3).astype("int32")}).to_parquet(tmp_path / "supplier.parquet")
    (tmp_path / "nation.parquet").symlink_to(f"{DATA}/nation.parquet")
    con = duckdb.connect()
    for name in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(ORACLES["g7_patristic"]).df()
    assert len(want) and rows(QUERIES["g7_patristic"](spark, str(tmp_path)).toPandas()) == rows(want)


@pytest.mark.parametrize("sent", [0, 256])
def test_many_vectors_are_not_broadcast(spark, monkeypatch, sent):
    """Also blocks and strata that are null keep their weights."""
    monkeypatch.setattr(replicates, "SENT", sent)
    df = spark.createDataFrame([(None if i % 5 == 0 else "ab"[i % 2], None if i == 7 else i, float(i)) for i in range(60)], "g string, id long, x double")
    drawn = replicates.drawn_weights(df, "id", 30, "n", ["g"])
    met, _ = replicates._joined(df, [(drawn, ["g", "id"])])
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert f"strategy={'broadcast' if sent else 'merge'}" in plan
    want = {r.replicate: r.s for r in resampling.weighted(df, resampling.draws(df, "id", 30, "n", ["g"]), ["g", "id"]).groupBy("replicate").agg(F.sum(F.col("weight") * F.col("x")).alias("s")).collect()}
    got = {r.replicate: r.s for r in replicates.replicate_sums(df, [(drawn, ["g", "id"])], 30, {"s": F.col("x")}).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_common_items_are_counted_in_blocks(spark, monkeypatch, group):
    """Several blocks and several strips of items give the pairs of the join, and none is cut."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("xy"[i % 2], f"s{i:02d}", int(j)) for i in range(40) for j in rng.choice(30, 1 + i % 12, replace=False)], "g string, id string, item long")
    want = {tuple(r)[:-1]: r.jaccard for r in graph.shared_jaccard(df, "id", "item", group).collect()}
    monkeypatch.setattr(graph, "SIDE", 7)
    monkeypatch.setattr(graph, "ITEMS", 4)
    called = []
    monkeypatch.setattr(graph, "_jaccard_of_blocks", lambda *a, f=graph._jaccard_of_blocks: called.append(1) or f(*a))
    got = {tuple(r)[:-1]: r.jaccard for r in graph.shared_jaccard(df, "id", "item", group).collect()}
    assert called and len(got) > 100 and got == want


@pytest.mark.parametrize("at_once", [16, 1 << 20])
def test_spanning_edges_with_ties_on_a_long_path(spark, monkeypatch, at_once):
    """Labels used to walk one node a round along the edges that components chose."""
    monkeypatch.setattr(graph, "EDGES", at_once)
    edges = [(i, i + 1, float(100 - i)) for i in range(70)] + [(i, i + 9, 5.0) for i in range(0, 60, 2)] + [(200, 201, 1.0)]
    part = {n: n for e in edges for n in e[:2]}

    def find(n):
        return n if part[n] == n else find(part[n])

    want = {e for e in edges if e[2] >= 99}
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            part[find(a)] = find(b)
            want.add((a, b, w))
    rounds = []
    monkeypatch.setattr(graph, "checkpoint", lambda df, f=graph.checkpoint: rounds.append(1) or f(df))
    assert {tuple(r) for r in graph.spanning_edges(spark.createDataFrame(edges, "a long, b long, w double").repartition(3), "w", 99.0).collect()} == want
    assert len(rounds) < 40


def test_equal_windows_are_matched_by_their_number(spark, monkeypatch):
    """The total is that of an assignment of single genes, while pairs of windows are scored once."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        gain = rng.integers(0, 5, (rng.integers(1, 6), rng.integers(1, 6))) / 7
        supply, demand = rng.integers(1, 5, gain.shape[0]), rng.integers(1, 5, gain.shape[1])
        single = gain.repeat(supply, 0).repeat(demand, 1)
        got = assignment.best_transport(gain, supply, demand)
        assert sum(n * gain[i, j] for i, j, n in got) == pytest.approx(sum(single[i, j] for i, j in assignment.best_assignment(single)))
        assert all(sum(n for i, _, n in got if i == k) <= supply[k] for k in range(len(supply))) and all(sum(n for _, j, n in got if j == k) <= demand[k] for k in range(len(demand)))
    windows = [["p", "q", "r"], ["q", "r", "s"], ["p", "s", "t"], ["t"], []]
    genes = [(i, "f", "left" if i % 3 else "right", windows[i * i % 5 if i % 2 else i % 5]) for i in range(60)]
    jaccard = lambda x, y: len({*x} & {*y}) / max(1, len({*x} | {*y}))
    own = [[w for _, _, s, w in genes if s == side] for side in ("left", "right")]
    gain = np.array([[jaccard(x, y) for y in own[1]] for x in own[0]])
    scored = []
    monkeypatch.setattr(assignment, "optimal_pairs", lambda s, *a, f=assignment.optimal_pairs: scored.append(s.count()) or f(s, *a))
    r = assignment.family_synteny(spark.createDataFrame(genes, "id long, family string, side string, window array<string>"), ["family"]).first()
    assert r.jaccard == pytest.approx(sum(gain[i, j] for i, j in assignment.best_assignment(gain)) / 40)
    assert scored[0] <= 16


@pytest.mark.parametrize("listed", [1, 3, 16])
def test_assigned_controls_beyond_what_was_listed(spark, monkeypatch, listed):
    """Only the first controls of a list leave the task; targets that use them up get more."""
    monkeypatch.setattr(resampling, "LISTED", listed)
    kept = []
    monkeypatch.setattr(resampling, "_least_hashed", lambda t, s, f=resampling._least_hashed: kept.append(f(t, s)) or kept[-1])
    pools = {t: [c for c in range(100, 112) if t < 9 or c < 105] for t in range(14)}
    got = resampling.assigned_controls(spark.createDataFrame([(t, c) for t in pools for c in pools[t]], "target_id long, control_id long"), 6, "s").collect()
    want = set()
    for r in range(1, 7):
        used = set()
        for t in sorted(pools):
            own = sorted(pools[t], key=lambda c: hashlib.sha256(f"s|{r}|{t}|{c}".encode()).digest())
            pick = next((c for c in own if c not in used), own[0])
            used.add(pick)
            want.add((r, t, pick))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert kept[0].selectExpr("max(size(_list))").first()[0] == min(listed, 12)


def test_resampled_spearman_meets_no_replicate_with_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i), float(rng.integers(0, 9)), int(rng.integers(0, 4)), float(rng.random())) for i in rng.integers(0, 6, 80)], "k long, a double, b long, c double")
    name = lambda r: (r.r_a_b, r.r_a_c, r.r_b_c)
    monkeypatch.setattr(resampling, "FEW", 0)
    want = {r.replicate: name(r) for r in resampling.spearman_block_bootstrap(df, "k", ["a", "b", "c"], 25, "s").collect()}
    monkeypatch.setattr(resampling, "FEW", 64)
    monkeypatch.setattr(resampling, "draws", None)
    got = {r.replicate: name(r) for r in resampling.spearman_block_bootstrap(df, "k", ["a", "b", "c"], 25, "s").collect()}
    assert len(got) == 25 and all(got[r] == pytest.approx(want[r]) for r in want)


def test_staged_match_limits_targets_before_the_shuffle(spark):
    t = spark.createDataFrame([(i, 1, float(i)) for i in range(6)], "target_id long, k long, x double")
    p = spark.createDataFrame([(100 + i, 1, i / 10) for i in range(60)], "control_id long, k long, y double")
    met = relational.staged_match(t, p, ["k"], "x", "y", [1.0, 9.0], 3, 4, F.col("control_id").cast("string"))
    assert met._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2
    got = {(r.target_id, r.place): r.control_id for r in met.collect()}
    nearest = lambda i: sorted(range(60), key=lambda c: (abs(c / 10 - i), str(100 + c)))[:4]
    assert got == {(i, n + 1): 100 + c for i in range(6) for n, c in enumerate(nearest(i))}


@pytest.mark.parametrize("dag", [False, True])
def test_closure_by_partitions_of_bounded_size(spark, monkeypatch, dag):
    """Depths, and distances of repeated pairs, of a deep hierarchy whose rows take many partitions; also where nodes have two parents."""
    monkeypatch.setattr(graph, "AT_ONCE", 40)
    parents = {n: {n - 1} if n < 12 else {n // 3} for n in range(1, 70)}
    if dag:
        for n in range(20, 70, 3):
            parents[n].add(n - 7)
    up = {0: {0: 0}}
    for n in sorted(parents):
        up[n] = {n: 0}
        for p in parents[n]:
            for a, d in up[p].items():
                up[n][a] = min(up[n].get(a, 99), d + 1)
    edges = spark.createDataFrame([(n, p) for n, ps in parents.items() for p in ps], "node long, parent long")
    closure = graph.ancestors(edges)
    assert sorted(map(tuple, closure.collect())) == sorted((n, a, d) for n in up for a, d in up[n].items() if a != n)
    pairs = [(a, b) for a in range(0, 70, 5) for b in range(0, 75, 4)] * 2
    nodes = spark.createDataFrame([(n,) for n in up], "node long")
    want = {(a, b): min((up[a][x] + up[b][x], x) for x in up[a].keys() & up[b].keys()) for a, b in pairs if a in up and b in up}
    got = graph.path_distance(spark.createDataFrame(pairs, "a long, b long"), graph.with_self(closure, nodes)).collect()
    assert {(r.a, r.b): (r.distance, r.ancestor) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("second", [None, 5])
def test_only_parents_are_sent_as_rests_of_paths(spark, monkeypatch, second):
    """Of a bushy hierarchy with nulls and repeated edges, also where a node has two parents; most nodes are nobody's parent."""
    sent, kind = [], type(spark.range(1))
    dealt = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt(self, *(sent.append(self.count()) or a if "_top" in self.columns else a)))
    parents = {n: {n // 3} for n in range(1, 200)}
    if second:
        parents[100].add(second)
    up = {0: {}}
    for n in sorted(parents):
        up[n] = {}
        for p in parents[n]:
            for a, d in {p: 0, **up[p]}.items():
                up[n][a] = min(up[n].get(a, 99), d + 1)
    edges = [(f"n{n}", f"n{p}") for n, ps in parents.items() for p in ps]
    df = spark.createDataFrame([*edges, *edges[:50], ("n0", None), (None, "n7"), (None, None)], "node string, parent string")
    got = [tuple(r) for r in graph.ancestors(df).collect()]
    null = [(None, a, d) for a, d in {"n7": 1, **{f"n{a}": d + 1 for a, d in up[7].items()}}.items()]
    assert sorted(got, key=str) == sorted([(f"n{n}", f"n{a}", d) for n in up for a, d in up[n].items()] + null, key=str)
    assert sent[0] == len({p for ps in parents.values() for p in ps} - {0}) and max(sent) < len(got) / 2


def test_strata_are_sent_as_often_as_partitions_need(spark, monkeypatch):
    """Many strata, a null one among them, go to one task each, and none of them meets a table of sizes; a lone one fills the partitions."""
    rows = [(None if i % 30 == 7 else f"g{i % 30}", i // 2, float(i % 13)) for i in range(600)]
    df, sums = spark.createDataFrame(rows, "g string, id long, x double"), {"n": F.lit(1), "s": F.col("x")}
    want = {}
    for own in (["g"], []):
        vectors = replicates.replicate_sums(df, [(replicates.drawn_weights(df, "id", 200, "n", own), [*own, "id"])], 200, sums)
        want[len(own)] = {r.replicate: (r.n, r.s) for r in vectors.collect()}
    sent, spread = [], replicates._spread
    monkeypatch.setattr(replicates, "_spread", lambda tasks: sent.append(tasks.count()) or spread(tasks))
    monkeypatch.setattr(replicates, "HASHES", 50)
    monkeypatch.setattr(replicates, "met_on", None)
    for own in (["g"], []):
        assert {r.replicate: (r.n, r.s) for r in replicates.drawn_sums(df, "id", 200, "n", sums, own).collect()} == want[len(own)]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sent[0] == 30 and partitions <= sent[1] <= replicates.SHARES * partitions + 1
    assert not replicates.drawn_sums(df.limit(0), "id", 200, "n", sums, ["g"]).collect()


def test_a_stratum_is_sent_a_bounded_number_of_times(spark, monkeypatch):
    """However many rows it has, so that what is sent grows with the rows."""
    sent = []
    spread = replicates._spread
    monkeypatch.setattr(replicates, "_spread", lambda tasks: sent.append(tasks.count()) or spread(tasks))
    monkeypatch.setattr(replicates, "HASHES", 50)
    monkeypatch.setattr(replicates, "AT_ONCE", 7)
    df = spark.createDataFrame([(i, "g", i % 3 // 2, float(i)) for i in range(40)], "id long, g string, y int, p double")
    got = {r.replicate: r.s1 for r in resampling.permutation_totals(df, ["g"], "id", "y", "p", 500, "b").collect()}
    assert sent[0] <= replicates.RANGES and len(got) == 500
    for r in (1, 97, 500):
        order = sorted(range(40), key=lambda i: hashlib.sha256(f"b|{r}|{i}".encode()).hexdigest())
        assert got[r] == sum(float(x) for i, x in enumerate(order) if i % 3 // 2 == 1)


@pytest.mark.parametrize("packed", [5, 100])
def test_shuffled_labels_are_bits(spark, monkeypatch, packed):
    monkeypatch.setattr(shuffles, "PACKED", packed)
    df = spark.createDataFrame([(i, i % 3 // 2) for i in range(20)], "id long, y int")
    for replicates_ in (3, 8, 21):
        got = {r.id: r.labels for r in shuffles.shuffled_labels(df, "id", "y", replicates_, "z").collect()}
        assert {len(x) for x in got.values()} == {-(-replicates_ // 8)}
        for r in range(1, replicates_ + 1):
            order = sorted(range(20), key=lambda i: hashlib.sha256(f"z|{r}|{i}".encode()).hexdigest())
            assert [got[x][(r - 1) // 8] >> (7 - (r - 1) % 8) & 1 for x in order] == [i % 3 // 2 for i in range(20)]


def test_places_of_a_batch_need_no_python_texts():
    """A batch of texts is not held a second time as Python strings; nulls and texts without a place stay what they are."""
    texts = pa.array([None, "", "CACACG", *["ACGT" * 5000 + "CACGCACG"] * 400])
    tracemalloc.start()
    got = sequence._places(texts, "(?=CACG)")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_000_000 < texts.nbytes
    assert got.type == pa.list_(pa.int32()) and got.to_pylist() == [None, [], [3], *[[20001, 20005]] * 400]
