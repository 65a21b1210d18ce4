"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over hashed
character n-grams (one to three characters) says which side a text is on: a
multinomial log-odds model whose mean over the text's n-grams is scaled by a logistic
fit. A text's language is the one whose codeword has the least exponential loss, each
bit weighted by how well its classifier does on learning texts. Up to seven languages
use the exhaustive code (2^(k-1) - 1 bits), more use random codewords that are far
apart. `ambiguous` flags texts whose two best codewords are close.

Learning takes at most `sample` rows for each language, those with the smallest hash
of doc_id, among texts of at most `longest` bytes; prediction reads every whole text in
one pass without a shuffle. The model holds 2^15 weights for each bit.

Edge cases: null texts and texts without a letter are `und` with score 0; rows without
doc_id are left out; rows without lang are predicted but not learnt from; with one
language everything else is that language, with none everything is `und`; of equally
near codewords the first language by name wins; repeated rows are predicted alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import small_batches, table

SAMPLE, TOTAL, LONGEST, BITS, CLOSE = 600, 6000, 20_000, 15, 0.2
_DIM = 1 << BITS
_CHUNK = 400_000


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        n = 2 ** (k - 1) - 1
        return np.array([[1] * n, *[[1 if (c >> (k - 2 - row)) & 1 else -1 for c in range(n)] for row in range(k - 1)]], float)
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k)))))
        near = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if near > apart and all(abs(c.sum()) < k for c in code.T):
            best, apart = code, near
    return best


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (three rows: one, two, three characters) and the texts' first places."""
    padded = [f" {t.lower()}  " for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in padded])[:-1])).astype(np.int64)
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(2654435761)
    two, three = one.copy(), one.copy()
    two[:-1] += c[1:] * np.uint32(40503) * np.uint32(2246822519) + np.uint32(1)
    three[:-1] += c[1:] * np.uint32(3266489917) + np.uint32(2)
    three[:-2] += c[2:] * np.uint32(668265263)
    mixed = np.stack([one, two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int32), starts


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about _CHUNK characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # n-gram, bit
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.code.shape[1]))
        for part in _chunks(texts):
            grams, starts = _ngrams(texts[part])
            sizes = np.diff(np.append(starts, grams.shape[1]))
            out[part] = sum(np.add.reduceat(self.weights[g], starts, axis=0) for g in grams) / sizes[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity flag of each text."""
        lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
        at = np.flatnonzero(lettered)
        lang, score, close = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if len(at) and self.langs:
            f = np.clip(self.margins([texts[i] for i in at]) * self.scale + self.shift, -20, 20)
            loss = np.exp(-f[:, None, :] * self.code[None] / 2) @ self.trust
            best = loss.argmin(1)
            p = np.exp(-(loss - loss.min(1, keepdims=True)))
            score[at] = 1 / p.sum(1)
            lang[at] = np.array(self.langs, object)[best]
            if len(self.langs) > 1:
                two = np.sort(loss, 1)[:, :2]
                close[at] = two[:, 1] - two[:, 0] < CLOSE
        return lang.tolist(), score, close


def learning_rows(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, total: int = TOTAL) -> list[tuple[str, str]]:
    """At most `sample` rows (lang, text) of each language, `total` in all, outside the held-out quarter.

    Two scans: one counts the languages, one fetches the rows whose hash is below their
    language's rate. The rate aims at 1.5 times the rows wanted; the smallest hashes stay.
    """
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 4 <> 2").where(F.octet_length("text").between(1, longest))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total).collect()
    each = max(1, min(sample, total // max(1, len(counts))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1_000_000, 1_500_000 * each // r["count"] + 1)) for r in counts], "lang string, rate long")
    drawn = usable.select("lang", "doc_id", "text").join(F.broadcast(rates), "lang").where(place < F.col("rate")).select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return sorted((r.lang, r.text) for r in drawn.withColumn("place", first).where(F.col("place") <= each).select("lang", "text").collect())


def fit(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    rows = learning_rows(docs, sample, longest)
    langs = sorted({lang for lang, _ in rows})
    code = codewords(len(langs))
    counts = np.zeros((len(langs), _DIM))
    for i, lang in enumerate(langs):
        own = [t for g, t in rows if g == lang]
        for part in _chunks(own):
            counts[i] += np.bincount(_ngrams(own[part])[0].ravel(), minlength=_DIM)
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))
    weights = np.stack([np.log((share[c > 0].mean(0) if (c > 0).any() else 0) + 1e-5) - np.log((share[c < 0].mean(0) if (c < 0).any() else 0) + 1e-5) for c in code.T], 1).astype(np.float32) if langs else np.zeros((_DIM, 0), np.float32)
    bits = code.shape[1]
    model = Model(langs, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    if len(langs) > 1:
        m, y = model.margins([t for _, t in rows]), code[[langs.index(g) for g, _ in rows]]
        for b in range(bits):
            a, w = np.c_[np.ones(len(m)), m[:, b]], np.zeros(2)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                w += np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ ((y[:, b] > 0) - p) - 1e-3 * w)
            model.shift[b], model.scale[b] = w
            model.trust[b] = max(0.05, 2 * (((a @ w > 0) == (y[:, b] > 0)).mean() - 0.5))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, close = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(each, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", F.expr("crc32(CAST(doc_id AS STRING)) % 4 = 2").alias("held_out"), "lang_pred", "score", "ambiguous")
