"""The pipeline's near-duplicate groups against all pairs compared, and the share of linked pairs that is found."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from brute import near_groups as groups  # noqa: E402
from fixtures import corpus, frame, rows  # noqa: E402

from weft.llm import near_dedup  # noqa: E402


def edited():
    rng = random.Random(8)
    say = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(n)]
    docs, common = [], say(12)
    for k in range(15):
        base = say(rng.choice([4, 9, 60, 200])) + common
        for c in range(6):
            w = list(base)
            for _ in range(c * len(base) // 60):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            docs.append((10 * k + c, " ".join(w)))
    return docs


def found(df, **settings):
    return rows(near_dedup.near_groups(df, **settings).select("doc_id", "component_id"), "doc_id")


@pytest.mark.parametrize("crowd", [1000, 64])
def test_groups_of_edited_copies(spark, crowd):
    docs = edited()
    assert found(frame(spark, docs), crowd=crowd) == groups(docs)


def test_sets_of_few_segments_meet_as_well(spark):
    rng = random.Random(3)
    docs = []
    for k in range(120):
        w = [f"{k}w{i}" for i in range(rng.randint(1, 16))]
        docs += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w, "more"])), (10 * k + 2, " ".join(w[1:] or ["one"])), (10 * k + 3, " ".join([*w, "more", "again"]))]
    assert found(frame(spark, docs)) == groups(docs)


def test_a_crowd_around_one_text(spark):
    """Copies of one text, each with edits of its own, in a crowd that is not compared each with each."""
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(150)]
    docs = []
    for c in range(260):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"edit{c}"
        docs.append((c, " ".join(w)))
    want = groups(docs)
    assert len({c for _, c in want}) > 5
    assert found(frame(spark, docs), crowd=8) == want


def test_crowds_in_small_blocks(spark, monkeypatch):
    """Chains of copies far from any hub, and copies around several texts of a common passage, over many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 900)
    monkeypatch.setattr(near_dedup, "SLICE_ROWS", 3)
    rng = random.Random(11)
    say = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n)]
    base, docs = say(120), []
    for c in range(60):  # each step drops another stretch of the base for words of its own
        w = list(base)
        w[2 * c : 2 * c + 4] = say(4)
        base = w if c % 3 else base
        docs.append((c, " ".join(w)))
    for k in range(6):
        own = base[:90] + say(12 + 4 * k)
        for c in range(12):
            w = list(own)
            for _ in range(c // 3):
                w[rng.randrange(len(w))] = f"edit{k}x{c}"
            docs.append((100 * (k + 1) + c, " ".join(w)))
    want = groups(docs)
    assert found(frame(spark, docs), crowd=3) == want


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_of_blocks(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    make = lambda n: [np.unique(np.concatenate((rng.integers(0, 40, rng.integers(1, 60)), rng.integers(0, 1 << 60, 5), rng.integers(1000, 9000, 80)))).astype(np.uint64) for _ in range(n)]
    a, b = make(70), make(90)
    assert near_dedup._overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_rows_that_share_an_id(spark):
    d = frame(spark, [(3, "same text of several words here"), (5, "own words that nobody else has at all"), (5, "same text of several words here"), (6, None), (6, None)])
    out = near_dedup.keep_one_of_each_group(spark, d)
    assert out.columns == d.columns
    assert rows(out.select("doc_id", "text"), "doc_id") == [(3, "same text of several words here"), (5, "own words that nobody else has at all"), (6, None)]


def test_groups_of_the_fixture_and_of_no_rows(spark):
    docs = corpus()[0]
    d = frame(spark, docs)
    assert found(d) == groups(docs)
    assert near_dedup.near_groups(d.where("doc_id < 0")).count() == 0


def test_the_stage_drops_an_edited_copy(spark):
    import corpus_pipeline

    docs = [(i, t) for i, t in corpus()[0] if i in (200, 211, 307)]
    assert [r[0] for r in rows(corpus_pipeline.near_dedup_stage(spark, frame(spark, docs), "").select("doc_id"), "doc_id")] == [200, 307]


def test_pairs_are_held_to_chains_of_segments(spark):
    rng = random.Random(5)
    docs, linked, others = {}, set(), set()
    for i in range(0, 240, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 6, 9, 30, 31, 33, 60, 200, 700]))]
        near = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 12, 60])):
            at = rng.randrange(len(near) + 1)
            near[at : at + rng.randrange(2)] = ["x%d" % rng.randrange(10**6)] * rng.randrange(2)
        docs[i], docs[i + 1] = " ".join(base), " ".join(near)
        a, b = (set(near_dedup._set(docs[j]).tolist()) for j in (i, i + 1))
        (linked if 9 * len(a & b) >= 4 * (len(a) + len(b)) else others).add((i, i + 1))
    d = frame(spark, list(docs.items()))
    node = {r["text"]: r["node"] for r in near_dedup._texts(d).collect()}
    of = {(node[docs[u]], node[docs[v]]): (u, v) for u, v in linked | others}
    found = {of[tuple(r)] for r in near_dedup.chained(d, spark.createDataFrame(list(of), "u long, hub long")).collect()}
    assert linked <= found and len(linked) > 30
    assert len(others - found) > len(others) / 2 > 10
