"""Language-model scores by masked pseudo-likelihood.

A network looks at a window of two words on each side of a masked word and predicts it:
one embedding for each of the four places, summed, a tanh layer, and a softmax in two
steps (a class, then a word of the class). The `CLASSES` * `MEMBERS` most frequent words
are predicted each by itself; a further class stands for all others, and such a word's
probability in it comes from how often the other documents of the corpus hold the word,
mixed with a model of its spelling (which gets the share of words seen once). So the
model is a distribution over all words, and a document is no evidence for itself: a word
that nothing else in the corpus has is unseen. In the window a word beyond the
vocabulary shows its last byte. A document's score is the sum, over its words, of the
log probability of each word given both sides (the masked pseudo-likelihood).

Everything is learnt from all documents. Words are counted in one pass. The network is
trained in numpy by tasks, each on all windows of its share: they start from one state,
fitted on at most `WARM` documents of at most `WARM_BYTES` bytes, by smallest hash, and their weights are averaged by numbers of windows
in a grouped sum, so only one set of weights reaches the driver. The vocabulary and at
most `LISTED` words that follow it travel with the tasks (a bounded table); rarer words meet
their counts in a join.

Edge cases: null and empty texts have no words and score 0; rows without doc_id are
left out; repeated rows are scored each, and are each other's evidence; with no words at
all every score is 0; words of equal counts are ordered by name; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import checkpoint
from weft.llm.common import small_batches, table, texts

CLASSES, MEMBERS = 32, 64
VOCABULARY = CLASSES * MEMBERS
#: Words after the vocabulary whose counts travel with the tasks.
LISTED = 131_072
#: Places of the window, relative to the masked word.
PLACES = (-2, -1, 1, 2)
#: Input symbols: 0 the edge of a text, then the vocabulary, then the last bytes of other words.
SYMBOLS = 1 + VOCABULARY + 256
HIDDEN, RATE, WINDOWS, WARM, WARM_BYTES = 16, 0.06, 8192, 1500, 20_000
_HELD = 200_000


def _words(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents. Tasks count first and let go of their counts when they hold many words."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(_words(t))
            if len(held) > _HELD:
                yield out()
                held.clear()
        yield out()

    return texts(docs).mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# words


def _spelling(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words one after the other: each byte's predecessor and the byte, 256 at both ends of a word, and where words start."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(sizes)
    now = np.full(ends[-1], 256, np.int64)
    inside = np.ones(len(now), bool)
    inside[ends - 1] = False
    now[inside] = np.frombuffer(b"".join(raw), np.uint8)
    return np.concatenate(([256], now[:-1])), now, ends - sizes


@dataclass
class Lexicon:
    """The most frequent words, how often all others occur, and how words are spelt."""

    words: list[str]  # by falling count: the vocabulary, then the listed words
    counts: np.ndarray
    rest: int  # occurrences of words beyond the vocabulary
    novel: float  # their share that goes to the spelling
    spelling: np.ndarray  # log p(byte | byte before), 256 at both ends

    def symbols(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of all words of some texts: input symbols, places in `words` (-1: not there), and the words that are not there."""
        if not hasattr(self, "_known"):
            self._known = {w: i for i, w in enumerate(self.words)}
            self._symbol = np.array([1 + i if i < VOCABULARY else 1 + VOCABULARY + w.encode()[-1] for i, w in enumerate(self.words)] + [0], np.int16)
        flat = [w for t in tokens for w in t]
        at = np.fromiter(map(self._known.get, flat, repeat(-1)), np.int32, len(flat))
        symbol = self._symbol[at]
        missing = np.flatnonzero(at < 0)
        absent = [flat[i] for i in missing]
        symbol[missing] = np.fromiter((1 + VOCABULARY + w.encode()[-1] for w in absent), np.int16, len(absent))
        return symbol, at, absent

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def spelt(self, words: list[str]) -> np.ndarray:
        """Log probability of each word's spelling."""
        if not words:
            return np.zeros(0)
        before, now, starts = _spelling([w.encode() for w in words])
        return np.add.reduceat(self.spelling[before, now], starts)


def lexicon(counts: DataFrame) -> Lexicon:
    # words of large counts: whole classes of counts, as many as fit
    size = F.floor(F.log("n") * 32).cast("int")
    classes = sorted(((r["c"], r["k"]) for r in counts.groupBy(size.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    held = np.cumsum([k for _, k in classes])
    fit = int((held <= VOCABULARY + LISTED).sum())
    least = classes[fit - 1][0] if fit else 1 << 20
    top = counts.where(size >= least)
    known = int(held[fit - 1]) if fit else 0
    if fit < len(classes) and known < VOCABULARY:  # the next class is too large to travel: its first words fill the vocabulary
        top = top.union(counts.where(size == classes[fit][0]).orderBy(F.desc("n"), "word").limit(VOCABULARY - known))
    rows = sorted(((-n, w) for w, n in top.select("word", "n").toPandas().itertuples(index=False)))
    words, n = [w for _, w in rows], np.array([-k for k, _ in rows], np.int64)
    total, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    rest = int(total) - int(n[:VOCABULARY].sum())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(257 * 257, np.int64)
        for b in batches:
            if b.num_rows:
                before, now, _ = _spelling([w.encode() for w in b.column("word").to_pylist()])
                cells += np.bincount(before * 257 + now, minlength=257 * 257)
        code = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(cells[code])], names=["code", "n"])

    spelt = counts.select("word").mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    cells = np.full(257 * 257, 0.01)
    cells[spelt.column("code").to_numpy()] += spelt.column("n").to_numpy()
    cells = cells.reshape(257, 257)
    return Lexicon(words, n, rest, min(0.5, (once + 1) / (rest + 2)), np.log(cells / cells.sum(1, keepdims=True)))


# the network


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of those."""
    z = h @ weights
    z += bias
    with np.errstate(over="ignore"):
        p = np.exp(z)
    norm = p.sum(1, keepdims=True)
    if not np.isfinite(norm.max(initial=0)):  # as good as never: h is at most 1
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        norm = p.sum(1, keepdims=True)
    return z, p, norm


class Network:
    """log p(word | window) = log softmax(h W + a)[class] + log softmax(h U[class] + u[class])[word], h = tanh(sum of place embeddings + b)."""

    SHAPES = {"e": (len(PLACES), SYMBOLS, HIDDEN), "b": (HIDDEN,), "w": (HIDDEN, CLASSES + 1), "a": (CLASSES + 1,), "u": (CLASSES, HIDDEN, MEMBERS), "v": (CLASSES, MEMBERS)}

    def __init__(self, weights: dict[str, np.ndarray], squares: dict[str, np.ndarray] | None = None):
        self.weights, self.squares = weights, squares or {k: np.full(s, 1e-6, np.float32) for k, s in self.SHAPES.items()}

    @classmethod
    def fresh(cls, lex: Lexicon) -> Network:
        rng = np.random.default_rng(11)
        n = np.full(VOCABULARY, 1e-3)
        n[: len(lex.words[:VOCABULARY])] += lex.counts[:VOCABULARY]
        n = n.reshape(CLASSES, MEMBERS)
        share = np.append(n.sum(1), lex.rest + 1e-3)
        w = {k: np.zeros(s, np.float32) for k, s in cls.SHAPES.items()}
        w["e"] = (rng.standard_normal(cls.SHAPES["e"]) * 0.1).astype(np.float32)
        w["w"] = (rng.standard_normal(cls.SHAPES["w"]) * 0.05).astype(np.float32)
        w["a"] = np.log(share / share.sum()).astype(np.float32)
        w["v"] = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in self.SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in cls.SHAPES.items():
            size = int(np.prod(s))
            out[k], at = flat[at : at + size].reshape(s).astype(np.float32), at + size
        return cls(out)

    def run(self, around: np.ndarray, target: np.ndarray, learn: bool = False) -> np.ndarray:
        """Log probability of each target symbol in its window (rows of `around`: places); if asked, a step of Adagrad as well."""
        w = self.weights
        h = np.tanh(sum(w["e"][p][around[p]] for p in range(len(PLACES))) + w["b"])
        z, p, norm = _softmax(h, w["w"], w["a"])
        known = target <= VOCABULARY
        cls = np.where(known, (target - 1) // MEMBERS, CLASSES)
        rows = np.arange(len(target))
        out = z[rows, cls] - np.log(norm[:, 0])
        if learn:
            p /= norm
            p[rows, cls] -= 1
            grad = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items() if k in "uv"}
            dh = p @ w["w"].T
        order = np.argsort(cls.astype(np.int8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = order[cuts[c] : cuts[c + 1]]
            if not len(own):
                continue
            hc = h[own]
            zc, pc, nc = _softmax(hc, w["u"][c], w["v"][c])
            member, k = (target[own] - 1) % MEMBERS, np.arange(len(own))
            out[own] += zc[k, member] - np.log(nc[:, 0])
            if learn:
                pc /= nc
                pc[k, member] -= 1
                grad["u"][c], grad["v"][c] = hc.T @ pc, pc.sum(0)
                dh[own] += pc @ w["u"][c].T
        if learn:
            dh *= 1 - h * h
            by = np.ascontiguousarray(dh.T, np.float64)
            grad |= {"w": h.T @ p, "a": p.sum(0), "b": dh.sum(0), "e": np.stack([np.stack([np.bincount(around[q], x, SYMBOLS) for x in by], 1) for q in range(len(PLACES))]).astype(np.float32)}
            for k, g in grad.items():
                g /= len(target)
                self.squares[k] += g * g
                w[k] -= RATE * g / np.sqrt(self.squares[k])
        return out

    def batches(self, symbols: np.ndarray, sizes: np.ndarray, learn: bool = False) -> np.ndarray:
        """run() over all words of some texts, WINDOWS at a time."""
        edge = len(PLACES) // 2
        padded = np.zeros(len(symbols) + edge * (len(sizes) + 1), np.int64)
        at = np.arange(len(symbols)) + edge * (1 + np.repeat(np.arange(len(sizes)), sizes))
        padded[at] = symbols
        out = np.zeros(len(symbols), np.float32)
        for i in range(0, len(at), WINDOWS):
            now = at[i : i + WINDOWS]
            out[i : i + WINDOWS] = self.run(np.stack([padded[now + p] for p in PLACES]), padded[now], learn)
        return out


def _tokens(b: pa.RecordBatch) -> tuple[list[list[str]], np.ndarray]:
    tokens = [_words(t) for t in b.column("text").to_pylist()]
    return tokens, np.fromiter(map(len, tokens), np.int64, len(tokens))


def train(docs: DataFrame, lex: Lexicon) -> Network:
    """Fitted first on few documents in the driver, then by every task on all of its windows; the tasks' weights are averaged."""
    short = texts(docs).where(F.octet_length("text").between(1, WARM_BYTES)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    rate = min(1.0, 1.2 * WARM / max(1, short.count()))
    few = short.where(F.col("h") <= int(rate * (1 << 40))).groupBy("h").agg(F.min("text").alias("text")).collect()
    tokens = [_words(r.text) for r in sorted(few, key=lambda r: r.h)[:WARM]]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = Network.fresh(lex)
    symbols = lex.symbols(tokens)[0]
    for _ in range(3):
        start.batches(symbols, sizes, learn=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, windows = start, 0
        for b in batches:
            tokens, sizes = _tokens(b)
            net.batches(lex.symbols(tokens)[0], sizes, learn=True)
            windows += int(sizes.sum())
        if windows:
            w = net.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w * windows), pa.array(np.full(len(w), windows, np.int64))], names=["place", "weight", "windows"])

    total = texts(docs).mapInArrow(each, "place int, weight double, windows long").groupBy("place").agg((F.sum("weight") / F.sum("windows")).alias("weight")).toArrow()
    flat = start.flat().astype(np.float64)
    flat[total.column("place").to_numpy()] = total.column("weight").to_numpy()
    return Network.of(flat)


# scores


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, net: Network) -> DataFrame:
    """(doc_id, n_words, n_unseen, log_likelihood, mean_log_likelihood) for every row; unseen words are in no other row."""
    small_batches(docs.sparkSession)
    novel = lex.novel

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = lex.spelt(lex.words[VOCABULARY:])
        for b in batches:
            tokens, sizes = _tokens(b)
            symbols, at, absent = lex.symbols(tokens)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = np.bincount(doc, net.batches(symbols, sizes), len(sizes))
            others = np.maximum(1, lex.rest - np.bincount(doc[symbols > VOCABULARY], minlength=len(sizes)))
            # listed words: their counts are here
            listed = at >= VOCABULARY
            pair, uses = np.unique(doc[listed] * LISTED + at[listed] - VOCABULARY, return_counts=True)
            of, word = pair // LISTED, pair % LISTED
            left = lex.counts[VOCABULARY:][word] - uses
            with np.errstate(divide="ignore"):
                base += np.bincount(of, uses * np.logaddexp(np.log((1 - novel) * left / others[of]), np.log(novel) + spelt[word]), len(sizes))
            unseen = np.bincount(of[left == 0], uses[left == 0], len(sizes)).astype(np.int64)
            # rarer ones go to meet theirs
            rare = Counter(zip(doc[at < 0].tolist(), absent, strict=True))
            names = [w for _, w in rare]
            of = np.fromiter((d for d, _ in rare), np.int64, len(rare))
            none = [None] * len(rare)
            key = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 42) for w in names), np.uint64, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column("row").take(pa.array(of)), b.column("row")]),
                    pa.array(np.concatenate((key, b.column("row").to_numpy()))),
                    pa.array([*rare.values(), *[None] * len(sizes)], pa.int32()),
                    pa.array(np.concatenate((lex.spelt(names), np.zeros(len(sizes)))), pa.float32()),
                    pa.array(np.concatenate((others[of], others))),
                    pa.concat_arrays([pa.array(none, pa.int64()), b.column("doc_id").cast(pa.int64())]),
                    pa.array([*none, *sizes.tolist()], pa.int64()),
                    pa.array([*none, *unseen.tolist()], pa.int64()),
                    pa.array([*none, *base.tolist()], pa.float64()),
                ],
                names=["row", "key", "uses", "spelt", "others", "doc_id", "n_words", "unseen", "base"],
            )

    rows = texts(docs).withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(each, "row long, key long, uses int, spelt float, others long, doc_id long, n_words long, unseen long, base double")
    # `counts` holds every word that is not listed, and by chance a document's own key
    held = counts.select(F.xxhash64("word").alias("key"), "n")
    left = F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.col("uses"))
    p = F.when(left == 0, F.log(F.lit(novel)) + F.col("spelt")).otherwise(F.log((1 - novel) * left / F.col("others") + novel * F.exp("spelt")))
    g = rows.join(held, "key", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.count("doc_id").alias("copies"),
        F.max("n_words").alias("n_words"),
        (F.sum("unseen") + F.coalesce(F.sum(F.when(left == 0, F.col("uses"))), F.lit(0))).alias("unseen"),
        (F.sum("base") + F.coalesce(F.sum(F.col("uses") * p), F.lit(0.0))).alias("sum"),
    )
    each_row = g.select("doc_id", "n_words", (F.col("unseen") / F.col("copies")).cast("long").alias("n_unseen"), (F.col("sum") / F.col("copies")).alias("log_likelihood"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each_row.select("doc_id", "n_words", "n_unseen", "log_likelihood", F.coalesce(F.try_divide("log_likelihood", "n_words"), F.lit(0.0)).alias("mean_log_likelihood"))


def fit(docs: DataFrame) -> tuple[DataFrame, Lexicon, Network]:
    counts = checkpoint(word_counts(docs))
    lex = lexicon(counts)
    return counts, lex, train(docs, lex)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
