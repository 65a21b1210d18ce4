"""Folds, layouts and splits of trees, and family synteny, against plain recursion and exhaustive matching."""

import itertools
import random
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import __spark_entry__  # noqa: E402
from test_brute import DATA  # noqa: E402

from weft.operators import assignment, graph, trees
from weft.sources import readers

TEXTS = {
    1: "((a:1,b:2)x:1,(c:1,(d:3,e:.5)y:1)z:2)r;",
    2: "((a,c),(b,(d,(e,f))));",
    3: "(a,b);",
    4: "(" * 150 + "t0" + "".join(f",t{k})" for k in range(1, 151)) + ";",
    5: "((((a:0,b:0):0,c:0):0)u:0,d:0,e:0);",
    6: "(q,(r,s),(t,v));",
}


@pytest.fixture(scope="module")
def edges(spark):
    t = spark.createDataFrame(list(TEXTS.items()), "tree int, newick string")
    return readers.newick_edges(t, "tree", "newick").cache()


def plain(edges):
    """tree -> node -> (parent, children, label, length)"""
    out = {}
    for r in sorted(edges.collect(), key=lambda r: (r.tree, r.node)):
        own = out.setdefault(r.tree, {})
        own[r.node] = [r.parent, [], r.label, r.branch_length or 0.0]
        if r.parent is not None:
            own[r.parent][1].append(r.node)
    return out


def test_layout_and_folds(edges):
    sys.setrecursionlimit(10_000)
    got = {(r.tree, r.node): (r.x, r.y) for r in trees.layout(edges, "tree").collect()}
    sizes = {(r.tree, r.node): r.value for r in trees.fold_up(edges, trees.tips(edges, "tree").selectExpr("tree", "node", "1 AS value"), "tree").collect()}
    n = 0
    for tree, nodes in plain(edges).items():
        flat = not any(v[3] for v in nodes.values())
        places = {k: i for i, k in enumerate(k for k, v in sorted(nodes.items()) if not v[1])}

        def y(k):
            kids = nodes[k][1]  # noqa: B023
            return sum(map(y, kids)) / len(kids) if kids else float(places[k])  # noqa: B023

        def x(k):
            up, _, _, length = nodes[k]  # noqa: B023
            return 0.0 if up is None else x(up) + (1.0 if flat else length)  # noqa: B023

        def size(k):
            return sum(map(size, nodes[k][1])) if nodes[k][1] else 1  # noqa: B023

        for k in nodes:
            n += 1
            assert got[tree, k] == pytest.approx((x(k), y(k)))
            assert sizes[tree, k] == size(k)
    assert len(got) == len(sizes) == n


def test_a_leaf_without_a_value_is_an_error(edges):
    with pytest.raises(ValueError, match="no value"):
        trees.fold_up(edges, trees.tips(edges, "tree").where("label <> 'a'").selectExpr("tree", "node", "1 AS value"), "tree")


def plain_splits(nodes, common):
    def under(k):
        kids = nodes[k][1]
        return frozenset().union(*map(under, kids)) if kids else frozenset([nodes[k][2]])

    sides = {under(k) & common for k, v in nodes.items() if v[1]}
    first = min(common)
    return {common - s if first in s else s for s in sides if 2 <= len(s) <= len(common) - 2}


def test_split_distances(spark, edges):
    own = plain(edges)
    pairs = list(itertools.combinations(sorted(own), 2)) + [(1, 1)]
    got = {(r.a, r.b): (r.common, r.differing, r.distance) for r in trees.split_distances(edges, spark.createDataFrame(pairs, "a int, b int"), "tree").collect()}
    for a, b in pairs:
        tips = [{v[2] for v in own[t].values() if not v[1]} for t in (a, b)]
        common = frozenset(tips[0] & tips[1])
        if len(common) < 4:
            assert got[a, b] == (len(common), None, None)
        else:
            k = len(plain_splits(own[a], common) ^ plain_splits(own[b], common))
            assert got[a, b] == (len(common), k, k / (2 * (len(common) - 3)))
    assert got[1, 2][1] > 0 and got[1, 1] == (5, 0, 0.0)


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def best_total(left, right):
    """Largest total over all one-to-one matches, by memory of the used right ones."""
    if len(left) > len(right):
        left, right = right, left
    best = {0: 0.0}
    for a in left:
        after = {}
        for used, total in best.items():
            for j, b in enumerate(right):
                if not used >> j & 1:
                    k = used | 1 << j
                    after[k] = max(after.get(k, 0.0), total + jaccard(a, b))
        best = after
    return max(best.values())


def test_family_synteny(spark):
    rng = random.Random(8)
    genes = [(i, f"f{i % 4}", rng.choice(["left", "right"]), [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for i in range(44)] + [(90, "alone", "left", ["a"]), (91, "none", "left", []), (92, "none", "right", ["a"])]
    got = {r.family: r for r in assignment.family_synteny(spark.createDataFrame(genes, "id long, family string, side string, window array<string>"), ["family"]).collect()}
    assert set(got) == {"f0", "f1", "f2", "f3", "none"} and got["none"].jaccard == got["none"].lcs == 0
    for f in ("f0", "f1", "f2", "f3"):
        left, right = ([w for _, g, s, w in genes if g == f and s == side] for side in ("left", "right"))
        assert (got[f].n_left, got[f].n_right) == (len(left), len(right)) and min(len(left), len(right)) > 1
        assert got[f].jaccard == pytest.approx(best_total(left, right) / max(len(left), len(right)))
        assert 0 < got[f].lcs <= 1


def test_synteny_query(spark):
    p = pd.read_parquet(f"{DATA}/part.parquet").sort_values("p_partkey")
    p["family"] = p.p_type + "|" + p.p_size.astype(str)
    windows = {}
    for _, own in p.groupby("p_brand"):
        names, keys = own.family.tolist(), own.p_partkey.tolist()
        for i, k in enumerate(keys):
            windows[k] = names[max(0, i - 5) : i] + names[i + 1 : i + 6]
    want = {}
    for f, own in p.groupby("family"):
        left = [windows[k] for k, b in zip(own.p_partkey, own.p_brand) if int(b[6:]) <= 10]
        right = [windows[k] for k, b in zip(own.p_partkey, own.p_brand) if int(b[6:]) > 10]
        if left and right:
            want[f] = (len(left), len(right), best_total(left, right) / max(len(left), len(right)))
    got = __spark_entry__.queries()["g8_synteny"](spark, DATA).collect()
    assert {r.family: (r.n_left, r.n_right) for r in got} == {f: v[:2] for f, v in want.items()} and want
    assert {r.family: r.jaccard for r in got} == pytest.approx({f: v[2] for f, v in want.items()}, abs=1e-7)


def test_rooting_and_order_read_the_texts_once(spark):
    """Also where an id is null, comes twice, or has no outgroup."""
    rooted, twice = "((s:2.5,b:0.5)0.9:0.25,(c:1,e:4)0.7:2);", "(c:1,(d:1,f:2)x:3);"
    df = spark.createDataFrame([("t1", rooted), ("t2", "(a:1,b:2);"), (None, rooted), ("t3", twice), ("t3", twice)], "id string, newick string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    e = readers.newick_edges(df, "id", "newick")
    r = graph.rooted(e.mapInPandas(counted, e.schema), "id", "c")
    places = {tuple(x) for x in graph.tip_order(r, "id").collect()}
    assert places == {("t1", "c", 1), ("t1", "e", 2), ("t1", "s", 3), ("t1", "b", 4), ("t3", "d", 1), ("t3", "f", 2), ("t3", "c", 3), (None, "", 1)}
    t1 = {(x.node, x.parent, x.label, x.branch_length) for x in r.where("id = 't1'").collect()}
    assert t1 == {(-1, None, "", None), (0, 4, "0.7", 2.0), (1, 0, "0.9", 0.25), (2, 1, "s", 2.5), (3, 1, "b", 0.5), (4, -1, "", 0.5), (5, -1, "c", 0.5), (6, 4, "e", 4.0)}
    assert [tuple(x) for x in r.where("id IS NULL").collect()] == [(None, -1, None, "", None)]
    assert r.where("id = 't3'").count() == 28 and read.value == e.count()
