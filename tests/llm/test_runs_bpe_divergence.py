"""Periodic runs, the backtracking encoder and the source audit against plain versions and the tokenizers library."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import corpus, frame, rows  # noqa: E402

from weft.llm import backtracking_bpe as bpe  # noqa: E402
from weft.llm import divergence, periodic  # noqa: E402

DOCS, _ = corpus()
PATH = P.path("byte_bpe_50k.json")
RUNS = [(500, "da dum " * 40), (501, "x " * 30 + "y " + "x " * 30), (502, "a b c " * 8 + "a b d"), (503, "w" + " w" * 23), (504, "w " * 23), (505, " ".join(f"{k % 50}" for k in range(200))), (506, "a a b " * 20 + "a b " * 20)]
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS + RUNS).cache()


def plain_runs(w):
    n, period = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                period.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in period.items())


def plain_op11(docs):
    out = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        out.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_periodic_runs(docs):
    assert rows(periodic.summary(periodic.with_periods(docs)), "doc_id") == plain_op11(DOCS + RUNS)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}
    assert got[500] == [(0, 80, 2)] and got[501] == [(0, 30, 1), (31, 30, 1)] and got[502] == [(0, 26, 3)] and got[503] == [(0, 24, 1)] and got[504] == [] and got[505] == [(0, 200, 50)]
    text = {r.doc_id: r.text for r in periodic.collapsed(docs).collect()}
    assert text[500] == "da dum" and text[502] == "a b c d" and text[300] == "" and text[504] == "w " * 22 + "w"


@pytest.mark.parametrize("kept", [16, 1 << 16])
def test_runs_of_random_words(kept, monkeypatch):
    monkeypatch.setattr(periodic, "GRID_WORDS", kept)
    rng, grids = random.Random(3), {}
    for _ in range(600):
        k, w = rng.randint(1, 4), []
        for _ in range(rng.randint(1, 12)):
            w += [rng.randint(0, k) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 2, 5, 9])
        assert periodic.find_runs(np.array(w, np.int32), grids) == plain_runs(w)


def test_runs_of_long_texts_stay_cheap():
    assert periodic.find_runs(np.zeros(150_000, np.int32)) == [(0, 150_000, 1)]
    assert periodic.find_runs(np.tile(np.arange(20_000), 4).astype(np.int32)) == [(0, 80_000, 20_000)]


def test_round_trip_like_the_library(docs):
    odd = [(600, "a<|endoftext|>b <|endoftext|><|endoftext|>"), (601, "<|endoftext|"), (602, "it's we'll I'd '' 's"), (603, " " * 3000 + "x" + "\n" * 2000), (604, "a" * 70_000), (605, "  \u0085  　١٢ ᾳ𝒳")]
    t = Tokenizer.from_file(PATH)
    session = docs.sparkSession
    all_docs = docs.unionByName(frame(session, odd))
    want = []
    for i, text in sorted(DOCS + RUNS + odd, key=lambda d: d[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))))
    encoded = bpe.encode(all_docs, PATH)
    assert rows(bpe.digests(encoded, PATH), "doc_id") == want
    assert rows(bpe.decode(encoded, PATH), "doc_id") == [(i, text or "") for i, text in sorted(DOCS + RUNS + odd, key=lambda d: d[0])]


def test_decoding_ids_that_are_no_text(spark):
    v = bpe.read_vocabulary(PATH)
    half = v.content.index(b"\xf0")
    given = spark.createDataFrame([(1, [half, 0, 60_000, -3, 1]), (2, None), (3, []), (4, [50256])], "doc_id long, ids array<int>")
    assert rows(bpe.decode(given, PATH), "doc_id") == [(1, '�!"'), (2, None), (3, ""), (4, "<|endoftext|>")]
    assert [r.n_tokens for r in bpe.digests(given, PATH).orderBy("doc_id").collect()] == [5, 0, 0, 1]


def test_merges_of_random_pieces_like_the_library():
    t, merge, find, rng = Tokenizer.from_file(PATH), bpe.encoder(bpe.read_vocabulary(PATH)), bpe.splitter(bpe.BYTE_LEVEL), random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "e", "th", "in", "er", " ", "  ", "é", "ing", "the", "\n", "0", "12", "!", "--", "'s", "ssss", "\U0001f642", "中"]) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for w in find(text) for i in merge(w.encode())] == ids.ids, text


def test_files_without_an_exact_way_are_refused():
    with pytest.raises(ValueError, match="pre_tokenizer|end_of_word"):
        bpe.read_vocabulary(P.path("word_bpe_49k.json"))


def plain_op13(docs, least, top):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        whole = Counter({t: sum(count[lang, s][t] for s in own) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = share(count[lang, source]), share(whole)
        pairs = sorted(((-sum(abs(p[t] - o[t]) for t in kept), s.encode()) for s in own if s != source for o in [share(count[lang, s])]))
        terms = sorted((q[t] - p[t], t.encode()) for t in kept if count[lang, source][t] and p[t] > q[t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block", "each"), [(30, 50, 128, 16_384), (3, 4, 2, 16), (500, 50, 128, 16_384)])
def test_source_divergence(spark, monkeypatch, least, top, block, each):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "VECTORS_EACH", each)
    rng = random.Random(4)
    held = [(t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", "S2", "é", "", None])) for _, t in DOCS] + [(None, "xx", "a"), ("", "xx", "b"), ("lonely " * 3, "yy", None)]
    d = spark.createDataFrame([(i, *h) for i, h in enumerate(held)], "doc_id long, text string, lang string, source string").repartition(3)
    got = divergence.audit(d, least, top).drop("q")
    assert sorted(map(tuple, got.collect())) == plain_op13(held, least, top)


def test_shares_are_exact_beyond_longs(spark):
    n, total, kept = 3 * 10**12 + 7, 9 * 10**17 + 1, 10**7
    got = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share("n", "total", "kept")).collect()[0][0]
    want = 1 + 10**9 * (n + 5) // (total + 5 * kept)
    assert got == want == divergence._shares(np.array([n]), np.array([total]), kept)[0]


def test_nothing(docs):
    none = docs.where("doc_id < 0")
    assert periodic.summary(periodic.with_periods(none)).count() == 0 and periodic.collapsed(none).count() == 0
    assert bpe.digests(bpe.encode(none, PATH), PATH).count() == 0
    assert divergence.audit(none).count() == 0
    unnamed = docs.sparkSession.createDataFrame([(None, "a a a")], "doc_id long, text string")
    assert periodic.periodic_runs(unnamed).count() == 0 and bpe.encode(unnamed, PATH).count() == 0


def test_round_trip_decodes_within_the_block(spark, monkeypatch):
    """Slices and several blocks give what encoding and decoding apart give, without a second Python worker for the ids."""
    from weft.llm import bpe

    monkeypatch.setattr(bpe, "SLICE", 3)
    monkeypatch.setattr(bpe, "ROW_WORDS", 20)
    texts = ["", None, "a b  c\n", "naïve 北京 \U0001f600", *[f"row {i} of {'many ' * (i % 7)}words" for i in range(40)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = bpe.round_trip(docs, block_bytes=150)
    ranks, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    apart = bpe.digests(bpe.encode(docs, ranks, pattern), ranks)
    stages = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert stages(got) < stages(apart)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect())) and got.count() == len(texts)
