"""Quality classifier: the difference between sizes compressed with two dictionaries.

From labelled text two zstandard dictionaries are built for each of two views of a
text: its bytes, and its shape (runs of letters, capitals and digits each become one
character). One of the two has seen good text, the other bad text. A text is cut into
pieces of `piece` bytes, so that the dictionaries and not the text's own repeats decide;
the normalised difference (bad - good) / max(bad, good) of the compressed sizes is one
feature for each view. A third tells how far the whole text shrinks without any
dictionary, which shows repetition. A logistic fit on labelled texts that are not in
the dictionaries turns them into a probability.

Learning takes at most `sample` labelled rows of each class, those with the smallest
hash of doc_id (one text each), among texts of at most `longest` bytes; scoring reads every whole text,
in one pass without a shuffle. The model is about 130 kB.

Edge cases: null and empty texts are scored like any text (all features zero but the
fitted constant); a score of exactly 0.5 counts as good; rows without doc_id are left
out by score() and keep_good(); labels of unknown documents or without a value are ignored; if
a class has no labelled text, every score is the share of label 1 (0.5 if there are no
labels); repeated rows are scored alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import small_batches, table, texts

SAMPLE, LONGEST, PIECE, DICTIONARY_BYTES, LEVEL = 2000, 20_000, 600, 32_768, 3
_SHAPE = bytes(ord("a") if 97 <= i <= 122 or i >= 128 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else i for i in range(256))
_RUN = re.compile(rb"(a|A|0)\1+")


def _views(text: bytes) -> tuple[bytes, bytes]:
    return text, _RUN.sub(rb"\1", text.translate(_SHAPE))


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: the text itself is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    """dictionaries[view][label]; weights over the standardised features, constant first."""

    dictionaries: list[list[bytes]] = field(default_factory=list)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    @functools.cached_property
    def _compressors(self):
        made = []
        for pair in self.dictionaries:
            made.append([])
            for content in pair:
                d = zstandard.ZstdCompressionDict(content)
                d.precompute_compress(level=LEVEL)
                made[-1].append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
        return made, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def features(self, text: str) -> list[float]:
        pairs, plain = self._compressors
        raw = text.encode("utf-8")
        out = []
        for view, (bad, good) in zip(_views(raw), pairs, strict=True):
            pieces = [view[i : i + PIECE] for i in range(0, len(view), PIECE)]
            b, g = sum(len(bad.compress(p)) for p in pieces), sum(len(good.compress(p)) for p in pieces)
            out.append((b - g) / max(b, g, 1))
        ratio = len(plain.compress(raw)) / (len(raw) + 40)
        return [*out, max(0.0, 0.45 - ratio), max(0.0, 0.25 - ratio), max(0.0, 0.1 - ratio)]

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(batch), self.prior)
        x = (np.array([self.features(t) for t in batch]).reshape(len(batch), -1) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[int, str, int]]:
    """At most `sample` rows (doc_id, text, quality) of each class outside the held-out third."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = functools.reduce(DataFrame.union, [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)])
    found = texts(docs).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text").between(1, longest)).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text, r.quality) for r in found.collect())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    rows = learning_rows(docs, labels, sample, longest)
    half = [zlib.crc32(str(r[0]).encode()) // 3 % 2 for r in rows]
    seen, held = [r for r, h in zip(rows, half, strict=True) if h == 0], [r for r, h in zip(rows, half, strict=True) if h]
    if any(not [r for r in part if r[2] == q] for part in (seen, held) for q in (0, 1)):
        return Model(prior=(sum(r[2] for r in rows) / len(rows)) if rows else 0.5)
    built = []
    for view in (0, 1):
        pieces = [[p[i : i + 1000] for _, t, q in seen if q == label for p in [_views(t.encode("utf-8"))[view]] for i in range(0, len(p), 1000)] for label in (0, 1)]
        built.append([_dictionary(p) for p in pieces])
    model = Model(built)
    x, y = np.array([model.features(t) for _, t, _ in held]), np.array([q for *_, q in held], float)
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.centre) / model.scale, y)
    # classes were sampled evenly at most; the constant follows the classes' shares in the labels
    share = labels.where("quality IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 3 <> 1").agg(F.avg("quality")).first()[0]
    drawn = y.mean()
    model.weights[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    model.prior = share
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(model.scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(each, "doc_id long, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("crc32(CAST(doc_id AS STRING)) % 3 = 1").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected (score at least 0.5), all columns kept."""
    small_batches(spark)
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score_of(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.fillna("").tolist()), dtype="float64")

    return docs.where("doc_id IS NOT NULL").where(score_of(F.col("text")) >= 0.5)
