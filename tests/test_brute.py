"""Registered queries without a SQL twin, against plain versions on the smallest tables."""

import hashlib
import math
import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import __spark_entry__  # noqa: E402
from plain import plain_tmm, ranks  # noqa: E402

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = __spark_entry__.queries()


def read(name, *columns):
    return pd.read_parquet(f"{DATA}/{name}.parquet", columns=list(columns) or None)


def run(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


def test_ols_hc3(spark):
    li = read("lineitem", "l_extendedprice", "l_quantity", "l_discount", "l_tax").astype(float)
    x, y = np.c_[np.ones(len(li)), li.iloc[:, 1:]], li.iloc[:, 0].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = (y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
    se = np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv))
    got = run(spark, "t13_ols_hc3").set_index("term").loc[["intercept", "l_quantity", "l_discount", "l_tax"]]
    assert got.beta.tolist() == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-3) and got.se.tolist() == pytest.approx(se.tolist(), rel=1e-6, abs=1e-3)


def test_partial_spearman(spark):
    li = read("lineitem", "l_extendedprice", "l_quantity", "l_discount", "l_tax").astype(float)
    a, b = (ranks(li[c]) for c in ("l_extendedprice", "l_quantity"))
    z = np.c_[np.ones(len(li)), li.l_discount, li.l_tax]
    left = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    assert run(spark, "t15_partial_spearman").iloc[0, 0] == pytest.approx(np.corrcoef(left(a), left(b))[0, 1], abs=1e-6)


def test_exact_intervals(spark):
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    for r in run(spark, "t16_clopper_pearson").itertuples():
        k, n = int(r.k), int(r.n)
        assert (r.low == 0) if k == 0 else tail(k, n, r.low) == pytest.approx(0.025, abs=1e-6)
        assert (r.high == 1) if k == n else 1 - tail(k + 1, n, r.high) == pytest.approx(0.025, abs=1e-6)


def test_tmm(spark):
    li = read("lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
    li = li.assign(s=li.l_suppkey % 4, g=li.l_partkey * 4 + li.l_linenumber % 4)
    wide = li.pivot_table(index="g", columns="s", values="l_quantity", aggfunc="sum", fill_value=0)
    got = run(spark, "t17_tmm_factors").sort_values("s")
    assert got.s.tolist() == wide.columns.tolist() and got.factor.tolist() == pytest.approx(plain_tmm(wide.to_numpy()).tolist(), abs=1e-6)


def test_score_tests(spark):
    docs = read("documents", "doc_id", "text", "n_chars").merge(read("labels", "doc_id", "quality"))
    x, y = np.c_[np.ones(len(docs)), np.log(docs.n_chars + 1)], docs.quality.to_numpy(float)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    w = p * (1 - p)
    got = run(spark, "t7_t8_score_tests").set_index("feature")
    import re

    counts = [pd.Series([t for t in re.split("[^a-z]+", (s or "").lower()) if 2 <= len(t) <= 4], dtype=object).value_counts() for s in docs.text]
    for feature in ("the", "de", "und", "que"):
        if feature not in got.index:
            continue
        f = np.array([c.get(feature, 0) for c in counts], float)
        v = f @ (w * f) - (x.T @ (w * f)) @ np.linalg.inv((x.T * w) @ x) @ (x.T @ (w * f))
        assert got.score[feature] == pytest.approx(f @ (y - p), abs=1e-4) and got.z[feature] == pytest.approx(f @ (y - p) / np.sqrt(v), abs=1e-4)


def test_rotations_and_components(spark):
    e = read("embeddings")
    e["k"] = e.sort_values("vec_id").groupby("label").cumcount()
    m = e.merge(e.assign(label=(e.label - 1) % 10), on=["label", "k"])
    a, b = (np.stack(m[c].to_numpy()).astype(float) for c in ("embedding_x", "embedding_y"))
    a, b = a - a.mean(0), b - b.mean(0)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    assert run(spark, "v3_procrustes").iloc[0, 0] == pytest.approx(np.sqrt(2 - 2 * np.linalg.svd(a.T @ b, compute_uv=False).sum()), abs=1e-5)
    x = np.stack(e.embedding.to_numpy()).astype(float)
    value = np.linalg.eigvalsh(np.cov((x - x.mean(0)).T))[::-1]
    assert run(spark, "v4_explained_variance").sort_values("component").share.tolist() == pytest.approx((value / value.sum())[:10].tolist(), abs=1e-6)


def test_spanning_edges(spark):
    j = run(spark, "g3_shared_jaccard")
    of = {n: n for n in {*j.a, *j.b}}

    def find(n):
        while of[n] != n:
            n = of[n]
        return n

    want = {(a, b) for a, b, w in zip(j.a, j.b, j.jaccard, strict=True) if w >= 0.95}
    # exact weights: rounding makes ties that the query does not have, so totals are compared
    total = 0.0
    for a, b, w in sorted(zip(j.a, j.b, j.jaccard, strict=True), key=lambda r: -r[2]):
        x, y = find(a), find(b)
        if x != y:
            of[x] = y
            total += w
    got = run(spark, "g3_spanning_edges")
    assert want <= set(zip(got.a, got.b, strict=True))
    tree = got[got.jaccard < 0.95].jaccard.sum() if want else got.jaccard.sum()
    assert want or tree == pytest.approx(total, abs=1e-4)


def test_greedy_match(spark):
    s, c = read("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), read("customer", "c_custkey", "c_nationkey", "c_acctbal")
    want = []
    for k, own in s.groupby("s_nationkey"):
        free = c[c.c_nationkey == k].sort_values("c_custkey")
        for t in own.sort_values("s_suppkey").itertuples():
            if len(free):
                i = (free.c_acctbal - t.s_acctbal).abs().idxmin()
                want.append((k, t.s_suppkey, free.c_custkey[i], round(abs(free.c_acctbal[i] - t.s_acctbal), 6)))
                free = free.drop(i)
    got = run(spark, "j17_greedy_match")
    plain = lambda rows: sorted((int(k), int(t), int(c), round(float(d), 4)) for k, t, c, d in rows)
    assert plain(got[["k", "target_id", "control_id", "distance"]].itertuples(index=False, name=None)) == plain(want)


def test_assigned_controls(spark):
    s, c = read("supplier", "s_suppkey", "s_nationkey"), read("customer", "c_custkey", "c_nationkey")
    m = s.assign(m=s.s_suppkey % 8).merge(c.assign(m=c.c_custkey % 8), left_on=["s_nationkey", "m"], right_on=["c_nationkey", "m"])
    pools = {t: own.c_custkey.tolist() for t, own in m.groupby("s_suppkey")}
    want = []
    for r in range(1, 101):
        used = set()
        for t in sorted(pools):
            own = sorted(pools[t], key=lambda x: (hashlib.sha256(f"r11|{r}|{t}|{x}".encode()).hexdigest(), x))
            pick = next((x for x in own if x not in used), own[0])
            used.add(pick)
            want.append((r, t, pick))
    got = run(spark, "r11_assigned_controls").sort_values(["replicate", "target_id"])
    assert len(want) and list(got[["replicate", "target_id", "control_id"]].itertuples(index=False, name=None)) == want


def test_spaced_controls(spark):
    windows = run(spark, "c10_control_windows").groupby("doc_id").start1.apply(list)
    got = run(spark, "c11_spaced_controls").set_index("doc_id").chosen
    assert set(got.index) == set(windows.index)
    for doc in list(windows.index)[:20]:
        chosen = []
        for x in sorted(windows[doc], key=lambda x: hashlib.sha256(f"c11|{doc}|{x}".encode()).hexdigest()):
            if len(chosen) < 10 and all(abs(x - y) >= 6 for y in chosen):
                chosen.append(x)
        assert list(got[doc]) == sorted(chosen)
