"""Planted answers, invariants and format readers."""

import hashlib
import itertools
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from plain import plain_tmm  # noqa: E402

from weft.functions import sequence as seq  # noqa: E402
from weft.operators import assignment, graph, integrity, intervals, metrics, ordered, relational, resampling, sampling, statistics, vectors  # noqa: E402
from weft.sources import readers, writers  # noqa: E402
from weft.streaming import events  # noqa: E402


def got(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_decision_from_planted_gains(spark):
    gains = {"tis": 0.03, "tts": 0.02, "splice_donor": 0.01, "splice_acceptor": -0.005}
    controls = {"base": 0.50, "herb": 0.51, "random_arm": 0.52, "matched_arm": 0.53}
    rows = [(s, t, r, a, v) for s in "abc" for t, g in gains.items() for r in ("linear", "xgboost") for a, v in {**controls, "tree": 0.53 + g}.items()]
    wide = relational.complete_pivot(spark.createDataFrame(rows, "slug string, task string, readout string, arm string, auprc double"), ["slug", "task", "readout"], "arm", [*controls, "tree"], "auprc")
    assert wide.count() == 24
    tasks = wide.withColumn("gain", F.col("tree") - F.greatest("herb", "random_arm", "matched_arm")).groupBy("task").agg(F.avg("gain").alias("m"))
    r = integrity.decision(tasks, F.col("m") > 0, 3, F.col("m") < -0.01).first()
    assert (r.positive_tasks, r.reversals, r.decision) == (3, 0, "continue_full_multiseed")


def test_pivot_with_a_hole_fails(spark):
    with pytest.raises(ValueError, match="hole"):
        relational.complete_pivot(spark.createDataFrame([("a", "x", 1.0)], "i string, c string, v double"), ["i"], "c", ["x", "y"], "v")


def test_average_precision_with_ties_by_hand(spark):
    s = [0.9, 0.9, 0.8, 0.7, 0.7, 0.7, 0.5, 0.4, 0.4, 0.3, 0.2, 0.1]
    y = [1, 0, 1, 0, 1, 0, 0, 1, 0, 0, 1, 0]
    want, tp = 0.0, 0
    for t in sorted(set(s), reverse=True):
        own = [b for a, b in zip(s, y) if a == t]
        tp += sum(own)
        want += sum(own) / sum(y) * tp / sum(a >= t for a in s)
    df = spark.createDataFrame(list(zip(s, y)), "p double, y int")
    assert metrics.average_precision(df, [], "p", "y").first()[0] == pytest.approx(want)
    pairs = [(a, b) for a, b in itertools.product(zip(s, y), zip(s, y)) if a[1] > b[1]]
    assert metrics.auroc(df, [], "p", "y").first()[0] == pytest.approx(sum(1.0 if a[0] > b[0] else 0.5 if a[0] == b[0] else 0 for a, b in pairs) / len(pairs))


def test_interval_islands(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 8), ("a", 2, 3), ("a", 10, 12), ("a", 1, 5), ("b", 4, 4)], "k string, s long, e long")
    assert got(intervals.islands(df, ["k"], "s", "e"), "k", "s") == [("a", 1, 8), ("a", 10, 12), ("b", 4, 4)]
    assert got(intervals.union_length(df, ["k"], "s", "e"), "k") == [("a", 11), ("b", 1)]


def test_running_sums_over_many_ranges(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("x")).repartition(7)
    r = got(ordered.running_sums(df, ["g"], ["o"], {"c": "x"}), "g", "o")
    want = []
    for g in range(3):
        c = 0
        for o in range(g, 500, 3):
            c += o * 7 % 11
            want.append((g, o, o * 7 % 11, c))
    assert r == want
    whole = got(ordered.equal_count_bins(df, ["o"], 7), "o")
    assert [b for *_, b in whole] == [i * 7 // 500 for i in range(500)] and sorted({sum(b == k for *_, b in whole) for k in range(7)}) == [71, 72]


def test_adjusted_p_keeps_null_and_order(spark):
    p = [0.01, 0.02, 0.02, None, 0.5, 0.9, 0.001]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    q = [r.q for r in ordered.adjusted_p(df, [], "p", "i").orderBy("i").collect()]
    vals = sorted(x for x in p if x is not None)
    want = {x: min(min(1.0, v * len(vals) / (k + 1)) for k, v in enumerate(vals) if v >= x) for x in vals}
    assert q[3] is None and all(a == pytest.approx(want[b]) for a, b in zip(q, p) if b is not None)


def test_checked_join_refuses_repeats_and_strays(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(1, "p"), (1, "q")], "k long, b string")
    with pytest.raises(relational.CardinalityError, match="repeats"):
        relational.checked_join(a, b, ["k"])
    with pytest.raises(relational.CardinalityError, match="partner"):
        relational.checked_join(a, b.limit(1), ["k"], require_match=True)
    assert relational.checked_join(a, b, ["k"], validate="one_to_many").count() == 2


def test_interval_overlaps_equal_the_plain_condition(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), int(s := rng.integers(500)), int(s + rng.integers(90))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k long, start long, end long")
    want = sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert got(relational.interval_overlaps(df, df, ["k"], 32), "k", "left_id", "right_id") == want


def test_staged_match_stages(spark):
    t = spark.createDataFrame([(-1, "k", 0.0), (-2, "k", 100.0), (-3, "k", 5000.0)], "target_id long, b string, x double")
    p = spark.createDataFrame([(i, "k", float(i)) for i in range(10)] + [(50 + i, "k", 100.0 + 9 * i) for i in range(5)], "control_id long, b string, y double")
    m = relational.staged_match(t, p, ["b"], "x", "y", [5, 40, 6000], 4, 3, F.col("control_id"))
    assert got(m.select("target_id", "stage", "pool_size").distinct(), F.desc("target_id")) == [(-1, 1, 6), (-2, 2, 5), (-3, 3, 15)]
    assert got(m.where("target_id = -1").select("control_id", "place"), "place") == [(0, 1), (1, 2), (2, 3)]


def test_greedy_and_optimal_matching(spark):
    t = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 5.0), ("s", 3, 9.0)], "k string, target_id long, x double")
    p = spark.createDataFrame([("s", 10, 4.0), ("s", 11, 6.0)], "k string, control_id long, x double")
    assert got(assignment.greedy_pairs(t, p, ["k"], "x"), "target_id") == [("s", 1, 10, 1.0), ("s", 2, 11, 1.0)]
    rng = np.random.default_rng(2)
    for n, m in ((3, 5), (5, 3), (4, 4), (1, 1)):
        g = rng.random((n, m))
        best = max(sum(g[i, j] for i, j in zip(range(n), c)) if n <= m else sum(g[i, j] for i, j in zip(c, range(m))) for c in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(g[i, j] for i, j in assignment.best_assignment(g)) == pytest.approx(best)


def test_longest_common_subsequence(spark):
    df = spark.createDataFrame([(list("abcbdab"), list("bdcaba")), ([], list("a")), (list("ab"), list("ab"))], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(assignment.lcs_share()("a", "b")).collect()] == [pytest.approx(4 / 7), 0.0, 1.0]


def test_motifs(spark):
    s = spark.createDataFrame([("AAAA",), ("CACGTGCACGTG",), ("",), ("NCACGN",)], "s string")
    c = seq.strand_counts(F.col("s"), ["CACGTG"])["CACGTG"]
    r = s.select(seq.overlapping_count(F.col("s"), "AA"), seq.nonoverlapping_starts(F.col("s"), "AA"), seq.overlapping_starts(F.col("s"), "AA"), c, seq.mutated(F.col("s"), seq.nonoverlapping_starts(F.col("s"), "CACG"), "CACG")).collect()
    assert [tuple(x) for x in r] == [(3, [1, 3], [1, 2, 3], 0, "AAAA"), (0, [], [], 2, "CCAGTGCCAGTG"), (0, [], [], 0, ""), (0, [], [], 0, "NCCAGN")]


def test_canonical_kmers(spark):
    df = spark.createDataFrame([(1, "ACGTNACG"), (2, None), (3, "AC")], "id long, s string")
    assert got(seq.kmer_counts(df, "id", "s", 3).select("id", seq.kmer_text(F.col("code"), 3), "n"), "id") == [(1, "ACG", 3)]


def test_ancestors_of_a_diamond_and_a_cycle(spark):
    e = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1), (5, 4), (1, None)], "node long, parent long")
    assert got(graph.ancestors(e), "node", "ancestor") == [(2, 1, 1), (3, 1, 1), (4, 1, 2), (4, 2, 1), (4, 3, 1), (5, 1, 3), (5, 2, 2), (5, 3, 2), (5, 4, 1)]
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(e.union(spark.createDataFrame([(1, 5)], "node long, parent long")))


def test_spanning_edges_are_a_maximum_forest(spark):
    rng = np.random.default_rng(3)
    edges = [(a, b, round(float(rng.random()), 3)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4 and (a < 8) == (b < 8)]
    r = got(graph.spanning_edges(spark.createDataFrame(edges, "a long, b long, w double"), "w", 2.0))
    parent = list(range(12))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    want = 0.0
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want += w
    assert sum(w for *_, w in r) == pytest.approx(want)


def test_bootstrap_draws_and_block_sums(spark):
    df = spark.createDataFrame([(i % 7, i % 2, float(i)) for i in range(70)], "block long, y int, v double")
    w = resampling.draws(df, "block", 30, "t")
    assert {r[0] for r in w.groupBy("replicate").agg(F.sum("weight")).select("sum(weight)").collect()} == {7}
    b = {r.replicate: r.difference for r in resampling.mean_difference_bootstrap(df, "block", "y", "v", 30, "t").collect()}
    rows = [(i % 7, i % 2, float(i)) for i in range(70)]
    for rep in (1, 17, 30):
        k = {r.block: r.weight for r in w.where(F.col("replicate") == rep).collect()}
        mean = lambda c: sum(v * k.get(g, 0) for g, y, v in rows if y == c) / sum(k.get(g, 0) for g, y, v in rows if y == c)  # noqa: B023, E731
        assert b[rep] == pytest.approx(mean(1) - mean(0))


def test_permutation_keeps_the_counts_of_each_stratum(spark):
    df = spark.createDataFrame([(i % 3, i, i % 5 // 4) for i in range(60)], "s long, id long, y int")
    p = resampling.permuted_labels(df, ["s"], "id", "y", 5, "p")
    assert p.count() == 300
    want = dict(got(df.groupBy("s").agg(F.sum("y"))))
    assert all(n == want[s] for s, _, n in got(p.groupBy("s", "replicate").agg(F.sum("permuted"))))


def test_ols_hc3_and_partial_spearman(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=80) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    m = np.c_[np.ones(80), x]
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    e = (y - m @ beta) / (1 - np.einsum("ij,jk,ik->i", m, inv, m))
    se = np.sqrt(np.diag(inv @ (m * e[:, None] ** 2).T @ m @ inv))
    r = statistics.ols_hc3(df, "y", ["a", "b"]).collect()
    assert [z.beta for z in r] == pytest.approx(beta) and [z.se for z in r] == pytest.approx(se)
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    res = lambda v: v - np.c_[np.ones(80), x[:, 1]] @ np.linalg.lstsq(np.c_[np.ones(80), x[:, 1]], v, rcond=None)[0]
    assert statistics.partial_spearman(df, "y", "a", ["b"]) == pytest.approx(np.corrcoef(res(rank(y)), res(rank(x[:, 0])))[0, 1])


def test_logistic_null_and_score_test(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y int")
    beta = statistics.logistic_null(df, "y", ["x"])
    m = np.c_[np.ones(300), x]
    mu = 1 / (1 + np.exp(-m @ beta))
    assert np.abs(m.T @ (y - mu)).max() < 1e-5
    f = rng.integers(0, 3, 300).astype(float)
    feats = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(f) if v], "id long, feature string, value double")
    r = statistics.score_tests(df, feats, "id", "y", ["x"], beta).first()
    w = mu * (1 - mu)
    v = f @ (w * f) - (m.T @ (w * f)) @ np.linalg.inv(m.T @ (m * w[:, None])) @ (m.T @ (w * f))
    assert (r.score, r.variance) == (pytest.approx(f @ (y - mu), abs=1e-6), pytest.approx(v))


def test_exact_interval_and_tails(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10)], "k long, n long")
    r = [tuple(x[0]) for x in df.select(statistics.clopper_pearson()("k", "n")).collect()]
    assert r[0] == (0.0, pytest.approx(0.3084971, abs=1e-6)) and r[1] == (pytest.approx(0.6915029, abs=1e-6), 1.0)
    assert r[2] == (pytest.approx(0.1870860, abs=1e-6), pytest.approx(0.8129140, abs=1e-6))
    z = spark.createDataFrame([(0.0,), (1.959963984540054,)], "z double").select(statistics.normal_tail()("z")).collect()
    assert [x[0] for x in z] == [0.5, pytest.approx(0.025)]


def test_factors(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(5, 200, 60)
    df = spark.createDataFrame([(f"s{k}", f"g{i}", int(b * m)) for k, m in enumerate((1, 2, 3)) for i, b in enumerate(base)], "s string, g string, y long")
    assert [f for _, f in got(statistics.tmm_factors(df, "s", "g", "y", least=20), "s")] == pytest.approx([1, 1, 1])
    with pytest.raises(ValueError, match="fewer than 100 genes"):
        statistics.tmm_factors(df, "s", "g", "y")
    assert [f for _, f in got(statistics.size_factors(df, "s", "g", "y"), "s")] == pytest.approx([1 / 6 ** (1 / 3), 2 / 6 ** (1 / 3), 3 / 6 ** (1 / 3)])
    lf = dict(got(statistics.log_factorials(df, 30)))
    assert all(lf[i] == pytest.approx(math.lgamma(i + 1)) for i in range(31))


def test_rotations_leave_no_procrustes_residual(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    df = spark.createDataFrame([(i, a.tolist(), (3 * a @ q + 1).tolist()) for i, a in enumerate(x)], "id long, x array<double>, y array<double>")
    assert vectors.procrustes_residual(df, "x", "y") < 1e-6
    assert vectors.linear_cka(df, "x", "y").first()[0] == pytest.approx(1)


def test_allocation_and_mismatches(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "i long")
    assert [q for _, q in got(sampling.allocate(df, ["i"], 24), "i")] == [4, 4, 4, 3, 3, 3, 3]
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "k long, v double")
    assert got(integrity.frame_mismatches(a, a, ["k"], ["v"])) == []


GFF = "##gff\nchr1\tx\tgene\t10\t50\t.\t+\t.\tID=g1;Name=a b\nchr1\tx\tmRNA\t10\t50\t2.5\t+\t.\tgene_id \"g1\"; transcript_id \"t1\"\n"


def test_text_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert got(readers.fasta(spark, put("a.fa", ">p1 first one\nacg\nTT\n>p2\n\n>p3 z\r\nAA*\r\n")), "record_id") == [("p1", "first one", "ACGTT"), ("p2", "", ""), ("p3", "z", "AA*")]
    g = readers.gff(spark, put("a.gff", GFF)).orderBy("feature").collect()
    assert (g[0].start1, g[0].attributes, g[1].score, g[1].attributes["transcript_id"]) == (10, {"ID": "g1", "Name": "a b"}, 2.5, "t1")
    bad = put("bad.gff", GFF + "chr1\tonly\n")
    with pytest.raises(Exception, match="nine fields"):
        readers.gff(spark, bad).collect()
    assert readers.gff(spark, bad, strict=False).count() == 2
    obo = "format-version: 1.2\n\n[Term]\nid: A\nname: root\nnamespace: p\n\n[Term]\nid: B\nname: leaf\nis_a: A ! root\nrelationship: part_of A\n\n[Term]\nid: C\nis_obsolete: true\nis_a: A\n\n[Typedef]\nid: part_of\n"
    terms, edges = readers.obo(spark, put("a.obo", obo))
    assert got(terms.select("id", "name", "obsolete"), "id") == [("A", "root", False), ("B", "leaf", False), ("C", None, True)]
    assert got(edges, "relation") == [("B", "A", "is_a"), ("B", "A", "part_of")]
    gaf = "!gaf\n" + "".join("\t".join(["db", g, g, q, t, "r", e] + ["x"] * 8) + "\n" for g, q, t, e in [("g1", "", "B", "IDA"), ("g2", "NOT|x", "B", "IDA"), ("g3", "", "B", "IEA")])
    direct = readers.annotations(spark, put("a.gaf", gaf), ["IEA"])
    assert got(readers.propagated(direct, graph.ancestors(edges.select("node", "parent"))), "term") == [("g1", "A"), ("g1", "B")]
    assert got(readers.orthogroups(spark, put("og.txt", "OG1: s1|a s2|b\nOG2: s1|c\n")), "gene_id") == [("OG1", "s1", "a"), ("OG1", "s2", "b"), ("OG2", "s1", "c")]
    names = put("names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\ttwin\t|\t\t|\tscientific name\t|\n3\t|\ttwin\t|\t\t|\tscientific name\t|\n")
    unique, tree = readers.taxonomy(spark, names, put("nodes.dmp", "2\t|\t1\t|\n1\t|\t1\t|\n"))
    assert got(unique) == [("root", 1)] and got(tree, "node") == [(2, 1)]
    names = put("more.dmp", "5\t|\tfive\t|\t\t|\tscientific name\t|\n5\t|\tfife\t|\t\t|\tsynonym\t|\n6\t|\tsix\t|\t\t|\tscientific name\t|\n7\t|\tsix\t|\t\t|\tequivalent name\t|\n8\t|\tv\t|\t\t|\tcommon name\t|\n")
    unique, tree = readers.taxonomy(spark, names, put("deep.dmp", "1\t|\t1\t|\n5\t|\t3\t|\n3\t|\t1\t|\n"))
    assert got(unique, "name") == [("fife", 5), ("five", 5)]
    assert got(graph.ancestors(tree), "node", "depth") == [(3, 1, 1), (5, 3, 1), (5, 1, 2)]
    assert got(readers.soft(spark, put("a.soft", "^SAMPLE = S1\n!title = one = x\n^SAMPLE = S2\n!title = two\n")), "name") == [("SAMPLE", "S1", "title", "one = x"), ("SAMPLE", "S2", "title", "two")]
    line = "dom acc 10 prot - 100 1e-5 50.1 0 1 1 1e-3 2e-4 40 0 1 9 {} {} 1 9 0.9 a free text\n"
    assert readers.domain_table(spark, put("a.dom", "# c\n" + line.format(5, 20))).first().description == "a free text"
    with pytest.raises(Exception, match="bad coordinates"):
        readers.domain_table(spark, put("b.dom", line.format(5, 120))).collect()
    hits = "#motif_id\tmotif_alt_id\tsequence_name\tstart\tstop\tstrand\tscore\tp-value\tq-value\tmatched_sequence\nM1\ta\ts\t1\t6\t+\t9.5\t1e-6\t\tCACGTG\n"
    assert readers.motif_hits(spark, put("f.tsv", hits)).first()["q_value"] is None
    blocks = readers.motif_blocks(spark, put("m.meme", "MEME\n\nMOTIF A x\n1\n\nMOTIF B\n2\n\nMOTIF C\n3\n"), 2)
    assert got(blocks.select("motif_id", "chunk"), "motif_id") == [("A", 0), ("B", 1), ("C", 0)]
    assert got(readers.species_map(spark, put("sp.txt", "s1: Some plant: x\nnone\n"))) == [("s1", "Some plant: x")]
    t = spark.createDataFrame([("t", "((a:1,b:2)x:0.5,'c d':3)r;")], "id string, n string")
    assert got(readers.newick_edges(t, "id", "n"), "node") == [("t", 0, None, "r", None), ("t", 1, 0, "x", 0.5), ("t", 2, 1, "a", 1.0), ("t", 3, 1, "b", 2.0), ("t", 4, 0, "c d", 3.0)]
    put("state.json", '{"log_history": [{"step": 1, "loss": 2.5}, {"step": 2, "eval_loss": 1.0}], "other": 1}')
    assert got(readers.training_history(spark, str(tmp_path / "state.json")).drop("file"), "step") == [(1, 2.5, None), (2, None, 1.0)]
    assert got(readers.report_fields(spark, put("r.txt", "C:98.1%[S:90]\n"), complete=r"C:([0-9.]+)%", missing="M:([0-9]+)").select("complete", "missing")) == [("98.1", None)]
    na = readers.delimited(spark, put("n.tsv", "# c\na\tb\nNA\t\n"), "a string, b string", comment="#", keep_na=True)
    assert got(na) == [("NA", "")]
    found = readers.files(spark, str(tmp_path), "*.gff")
    hashes = integrity.file_hashes(found)
    assert hashes.count() == 2 and got(integrity.freeze_mismatches(hashes.select("path", "sha256"), hashes)) == []
    pick = spark.createDataFrame([("g", "x/genes.gff3"), ("g", "x/g.gff"), ("g", "x/old.gff")], "grp string, path string")
    assert got(readers.shortest_name(pick, "grp", "path", "OLD")) == [("g", "x/g.gff")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGT" * 30, None), (2, "AC", 0.5)], "id long, sequence string, v double")
    writers.write_fasta(df.withColumn("record_id", F.col("id").cast("string")), str(tmp_path / "fa"))
    assert got(readers.fasta(spark, str(tmp_path / "fa")).select("record_id", "sequence"), "record_id") == [("1", "ACGT" * 30), ("2", "AC")]
    writers.write_delimited(df, str(tmp_path / "tsv"), gzip=True, one_file=True)
    assert got(readers.delimited(spark, str(tmp_path / "tsv"), "id long, sequence string, v double"), "id")[0][2] is None
    assert not writers.reusable(spark, str(tmp_path / "m"), seed="1")
    writers.write_with_manifest(df, str(tmp_path / "m"), ["id", "sequence"], seed="1")
    assert writers.reusable(spark, str(tmp_path / "m"), seed="1") and not writers.reusable(spark, str(tmp_path / "m"), seed="2")
    assert writers.markdown_table(df.select("id", "v").orderBy("id")) == "| id | v |\n| --- | --- |\n| 1 |  |\n| 2 | 0.5 |\n"


def test_streams_agree_with_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i // 10}:{i % 10 * 6:02d}:00", i % 2, "click", float(i)) for i in range(60)], "event_id long, ts string, user_id long, event_type string, value double")
    rows.select("event_id", F.to_timestamp_ntz("ts").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.append_available(events.tumbling(events.read(spark, str(tmp_path / "in")), "1 hour", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    done = got(spark.read.parquet(str(tmp_path / "out")), "start")
    assert done and set(done) <= set(got(events.tumbling(table, "1 hour")))
    assert got(events.sessions(table, "5 minutes").agg(F.sum("n"), F.count(F.lit(1)))) == [(60, 60)]


def test_a_mark_inside_a_header_begins_no_record(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">g1 c.12A>G variant\nACG\nT\n>g2\nNN\n")
    assert got(readers.fasta(spark, str(p)), "record_id") == [("g1", "c.12A>G variant", "ACGT"), ("g2", "", "NN")]


def test_of_a_repeated_attribute_the_last_counts(spark):
    df = spark.createDataFrame([("ID=1;Note=a;Note=b;tag=x;tag=x",), ('gene_id "g"; tag "a"; tag "b";',)], "a string")
    assert [r[0] for r in df.select(readers.attributes(F.col("a"))).collect()] == [{"ID": "1", "Note": "b", "tag": "x"}, {"gene_id": "g", "tag": "b"}]


def test_null_groups_and_values_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 2.0, 1), (None, 2, 1.0, 0), ("a", 3, 5.0, 1), ("a", 4, None, 0)], "g string, id long, x double, y int")
    assert got(ordered.average_ranks(df, ["g"], "x"), "id") == [(None, 1, 2.0, 1, 2.0), (None, 2, 1.0, 0, 1.0), ("a", 3, 5.0, 1, 1.0), ("a", 4, None, 0, None)]
    assert [r[-1] for r in got(ordered.equal_count_bins(df, ["id"], 2, group=["g"]), "id")] == [0, 1, 0, 1]
    assert [r[-1] for r in got(ordered.adjusted_p(df.withColumn("x", F.col("x") / 10), ["g"], "x", "id"), "id")] == [0.2, 0.2, 0.5, None]
    some = df.where("x IS NOT NULL")
    assert sorted(got(metrics.best_mcc_threshold(some, ["g"], "x", "y")), key=str)[1] == (None, 2.0, 1.0)
    assert {r[0] for r in got(metrics.top_k_enrichment(some, ["g"], "x", "y", "id"))} == {None, "a"}
    assert {r[0] for r in got(statistics.standardised(some, ["g"], "x"))} == {None, "a"}
    assert {r[0] for r in got(resampling.draws(df, "id", 3, "s", ["g"]))} == {None, "a"}


def test_an_unsettled_model_is_an_error(spark):
    df = spark.createDataFrame([(float(i), int(i > 9)) for i in range(20)], "x double, y int")
    with pytest.raises(ArithmeticError):
        statistics.logistic_null(df, "y", ["x"], steps=2)


def test_factors_of_sparse_counts(spark):
    rng = np.random.default_rng(16)
    counts = rng.poisson(rng.gamma(0.5, 8, (600, 1)) * rng.uniform(0.5, 2, (1, 5)) * rng.lognormal(0, 0.4, (600, 5)))
    df = spark.createDataFrame([(k, i, int(counts[i, k])) for i in range(600) for k in range(5) if counts[i, k] or k == 0], "s long, g long, y long")
    assert [f for _, f in got(statistics.tmm_factors(df, "s", "g", "y"), "s")] == pytest.approx(plain_tmm(counts).tolist())
    with pytest.raises(ValueError, match="empty library"):
        statistics.tmm_factors(df.union(spark.createDataFrame([(9, 1, 0)], df.schema)), "s", "g", "y")


def test_controls_by_rounds_are_those_taken_one_after_another(spark):
    import hashlib
    import random

    rng = random.Random(3)
    pairs = {(t, c) for t in range(25) for c in rng.sample(range(18), rng.randint(1, 6))}
    out = resampling.assigned_controls(spark.createDataFrame(sorted(pairs), "target_id long, control_id long"), 50, "s")
    want = []
    for r in range(1, 51):
        used = set()
        for t in range(25):
            own = sorted((c for a, c in pairs if a == t), key=lambda c: (hashlib.sha256(f"s|{r}|{t}|{c}".encode()).hexdigest(), c))
            pick = next((c for c in own if c not in used), own[0])
            used.add(pick)
            want.append((r, t, pick))
    assert got(out, "replicate", "target_id") == want
    assert got(resampling.assigned_controls(spark.createDataFrame([], "target_id long, control_id long"), 5, "s")) == []


def test_spaced_choice(spark):
    import hashlib

    starts = list(range(0, 300, 2))
    chosen = []
    for s in sorted(starts, key=lambda s: hashlib.sha256(f"k|{s}".encode()).hexdigest()):
        if len(chosen) < 10 and all(abs(s - c) >= 12 for c in chosen):
            chosen.append(s)
    df = spark.createDataFrame([(starts,)], "x array<long>")
    assert df.select(seq.spaced_choice(F.col("x"), 12, F.lit("k"), 10)).first()[0] == sorted(chosen)


def test_windows_are_drawn_from_every_start(spark):
    df = spark.createDataFrame([("a", 1, "A" * 30), ("a", 2, "A" * 12), ("b", 3, "N" * 30), ("b", 4, "ACGTN" * 3), ("c", 5, "AC")], "g string, id long, s string")
    out = got(sampling.sample_windows(df, "id", "s", 10, 0.2, 1000, "k", ["g"]), "g", "id", "start0")
    assert [(i, s) for _, i, s, *_ in out] == [(1, s) for s in range(21)] + [(2, s) for s in range(3)] + [(4, s) for s in range(6)]
    assert {r[4] for r in out if r[0] == "a"} == {24}
    few = got(sampling.sample_windows(df, "id", "s", 10, 0.2, 5, "k", ["g"]), "g", "place")
    assert [r[1:3] for r in few if r[0] == "a"] == [r[1:3] for r in sorted((r for r in out if r[0] == "a"), key=lambda r: r[3])[:5]]
    with pytest.raises(ValueError, match="fewer than"):
        sampling.sample_windows(df, "id", "s", 10, 0.2, 10, "k", ["g"], complete=True)


def test_cohorts_of_equal_budgets(spark):
    df = spark.createDataFrame([(a, 100 * k + i) for k, a in enumerate("xyz") for i in range(40)], "arm string, id long")
    out = sampling.equal_budget_cohorts(df, "arm", "id", ["x", "y", "z"], 20, "s")
    assert sorted((r.cohort, r["count"]) for r in out.groupBy("cohort").count().collect()) == [("union", 20), ("x", 20), ("y", 20), ("z", 20)]
    assert sorted((r.arm, r["count"]) for r in out.where("cohort = 'union'").groupBy("arm").count().collect()) == [("x", 7), ("y", 7), ("z", 6)]


def test_neighbours_across_stretches(spark):
    df = spark.range(10_000).select(F.lit("c").alias("g"), F.col("id").alias("p"))
    out = {r.p: (r.window, r.edge) for r in graph.neighbour_window(df, ["g"], "p", 10).collect()}
    assert len(out) == 10_000
    for p in (0, 9, 10, 4095, 4096, 4097, 8191, 8192, 9989, 9990, 9999):
        near = list(range(max(0, p - 10), min(10_000, p + 11)))
        assert out[p] == (near, len(near) < 21)


def test_cka_by_group_is_that_of_numpy(spark):
    rng = np.random.default_rng(19)
    x, y, g = rng.standard_normal((90, 70)), rng.standard_normal((90, 70)), rng.integers(0, 3, 90)
    y = y + x
    df = spark.createDataFrame([(int(k), [float(v) for v in a], [float(v) for v in b]) for k, a, b in zip(g, x, y)], "g long, x array<float>, y array<float>").repartition(4)

    def plain(a, b):
        a, b = a - a.mean(0), b - b.mean(0)
        return (np.linalg.norm(a.T @ b) ** 2) / np.linalg.norm(a.T @ a) / np.linalg.norm(b.T @ b)

    assert [c for _, c in got(vectors.linear_cka(df, "x", "y", ["g"]), "g")] == pytest.approx([plain(x[g == k], y[g == k]) for k in range(3)], rel=1e-5)


def test_rows_and_columns_are_looked_up(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, v string")
    assert readers.find_row(df, k="a").v == "x"
    for bad in ({"v": "x"}, {"k": "c"}):
        with pytest.raises(ValueError):
            readers.find_row(df, **bad)
    assert spark.createDataFrame([("mk*l#B*",)], "s string").select(readers.clean_residues(F.upper("s"))).first()[0] == "MKXLXB"
    assert relational.require_columns(df, "k") is df
    with pytest.raises(ValueError, match="missing"):
        relational.require_columns(df, "k", "z")


def test_greedy_matches_are_the_same_in_parts(spark):
    rng = np.random.default_rng(21)
    t = spark.createDataFrame([(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 2, 60), rng.uniform(0, 900, 60)))], "k long, target_id long, x double")
    p = spark.createDataFrame([(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 2, 90), rng.uniform(0, 900, 90)))], "k long, control_id long, x double")
    free, want = {(k, i): x for k, i, x in p.collect()}, []
    for k, i, x in sorted(t.collect(), key=lambda r: r[1]):
        near = min(((abs(x - v), c) for (q, c), v in free.items() if q == k), default=None)
        if near and near[0] <= 6:
            want.append((k, i, near[1], near[0]))
            del free[k, near[1]]
    assert len(want) > 20 and [r[:3] for r in got(assignment.greedy_pairs(t, p, ["k"], "x", caliper=6.0), "target_id")] == [w[:3] for w in want]


def test_greedy_matches_without_a_caliper_by_parts(spark):
    rng = np.random.default_rng(23)
    # a has many controls, b as many as targets, c fewer, with ties of values; d has none, and the null stratum one
    sizes = [("a", 60, 400), ("b", 60, 60), ("c", 60, 20), ("d", 5, 0), (None, 1, 1)]
    t = [(k, 100 * j + i, float(x)) for j, (k, n, _) in enumerate(sizes) for i, x in enumerate(rng.integers(0, 300, n))]
    p = [(k, 1000 * j + i, float(x)) for j, (k, _, n) in enumerate(sizes) for i, x in enumerate(rng.permutation(rng.integers(0, 300, n)))]
    free, want = {(k, c): x for k, c, x in p}, []
    for k, i, x in t:
        near = min(((abs(x - v), c) for (q, c), v in free.items() if q == k), default=None)
        if near:
            want.append((i, near[1], near[0]))
            del free[k, near[1]]
    dull = [("a", 9000, None), ("a", 9001, float("nan")), ("a", 9002, float("inf"))]
    tf, pf = spark.createDataFrame(t + dull, "k string, target_id long, x double"), spark.createDataFrame(p + dull, "k string, control_id long, x double")
    assert got(assignment.greedy_pairs(tf, pf, ["k"], "x").drop("k"), "target_id") == sorted(want)
    parts = assignment._apart(spark.createDataFrame(t, tf.schema), spark.createDataFrame(p, pf.schema), ["k"], "x").where("k = 'a'")
    assert parts.select("_part").distinct().count() > 5
    assert assignment.greedy_pairs(tf.limit(0), pf, ["k"], "x").count() == 0


def test_greedy_matching_looks_up_two_controls_a_target():
    import time

    start, n = time.time(), 200_000
    places = assignment.nearest_free(np.full(n, 0.5), np.arange(n, dtype=float), list(range(n)))
    assert places == list(range(n)) and time.time() - start < 20


def test_assignment_by_components_has_the_largest_total(spark):
    rng = np.random.default_rng(22)
    m = np.where(rng.random((7, 6)) < 0.35, rng.random((7, 6)), 0)
    df = spark.createDataFrame([("g", i, j, float(m[i, j])) for i in range(7) for j in range(6) if m[i, j]], "g string, a long, b long, s double")
    out = got(assignment.optimal_pairs(df, ["g"], "a", "b", "s"))
    best = max(sum(m[i, j] for i, j in zip(rows, range(6))) for rows in itertools.permutations(range(7), 6))
    assert sum(r[3] for r in out) == pytest.approx(best) and len({r[1] for r in out}) == len({r[2] for r in out}) == len(out)


def test_sites_of_a_long_text_are_found_and_exchanged_in_one_pass(spark):
    import time

    text = "CACGTTA" * 700_000 + "CACACACA"
    df = spark.createDataFrame([(text,), (None,), ("",)], "s string")
    start = time.time()
    n = F.size(seq.nonoverlapping_starts(F.col("s"), "CACG"))
    rows = df.select(n.alias("n"), F.sha2(seq.mutated(F.col("s"), seq.nonoverlapping_starts(F.col("s"), "CACG"), "CACG"), 256).alias("h"), F.size(seq.overlapping_starts(F.col("s"), "CACA")).alias("o")).collect()
    assert [r.n for r in rows][::2] == [700_000, 0] and rows[0].o == 3 and rows[1].h is None
    assert rows[0].h == hashlib.sha256(text.replace("CACG", "CCAG").encode()).hexdigest()
    assert time.time() - start < 90


def test_small_parts_of_greedy_matching_share_calls(spark):
    # 20,000 targets, each in a part of its own: a call for each took about 8 ms
    import time

    rng = np.random.default_rng(31)
    x = rng.permutation(20000) * 10.0
    n = spark.range(20000).withColumnRenamed("id", "target_id").join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "target_id long, x double"), "target_id")
    t = n.select((F.col("target_id") % 3).alias("k"), "target_id", "x")
    p = n.select((F.col("target_id") % 3).alias("k"), (F.col("target_id") + 100000).alias("control_id"), "x").crossJoin(spark.createDataFrame([(-1.5,), (1.0,), (4.0,)], "d double")).select("k", (F.col("control_id") * 3 + F.col("d").cast("int")).alias("control_id"), (F.col("x") + F.col("d")).alias("x"))
    start = time.time()
    found = got(assignment.greedy_pairs(t, p, ["k"], "x"), "target_id")
    assert found == [(i % 3, i, (i + 100000) * 3 + 1, 1.0) for i in range(20000)]
    assert time.time() - start < 40


def test_greedy_matching_of_text_ids_and_odd_strata(spark):
    nan = float("nan")
    t = spark.createDataFrame([(0.0, "b", 5), (-0.0, "a", 5), (nan, "c", 1), (nan, "d", 1), (None, "e", 2)], "k double, target_id string, x int")
    p = spark.createDataFrame([(-0.0, "x", 4), (0.0, "y", 6), (nan, "z", 0), (nan, None, 2), (None, None, 7)], "k double, control_id string, x int")
    want = [("a", "x", 1.0), ("b", "y", 1.0), ("c", "z", 1.0), ("d", None, 1.0), ("e", None, 5.0)]
    for caliper in (None, 100.0):
        assert got(assignment.greedy_pairs(t, p, ["k"], "x", caliper).drop("k"), "target_id") == want


def test_factors_take_equal_pairs_of_counts_once(spark):
    rng = np.random.default_rng(17)
    counts = rng.poisson(4 * rng.uniform(0.5, 2, (1, 4)) * rng.lognormal(0, 0.2, (3000, 4)))
    df = spark.createDataFrame([(k, i, int(counts[i, k])) for i in range(3000) for k in range(4)], "s long, g long, y long")
    ranked, plain = [], statistics.average_ranks
    statistics.average_ranks = lambda rows, *rest: ranked.append(rows.count()) or plain(rows, *rest)
    try:
        factors = [f for _, f in got(statistics.tmm_factors(df, "s", "g", "y"), "s")]
    finally:
        statistics.average_ranks = plain
    assert factors == pytest.approx(plain_tmm(counts).tolist())
    assert max(ranked) < 2000  # of over 8,000 genes of samples
    weighted = spark.createDataFrame([(1.0, 2), (2.0, 3), (None, 1)], "x double, c long")
    assert [r[2] for r in got(ordered.average_ranks(weighted, [], "x", times="c"), F.col("x").asc_nulls_last())] == [1.5, 4.0, None]
