"""BPE encoding by a backtracking encoder, decoding by an offset table.

A pre-token's exact merges are found left to right. An Aho-Corasick automaton over the
vocabulary gives the longest token that starts at each byte; it is taken if it may stand
after the token before it, else the next shorter token that is a prefix of it. If none
may, the last token is taken back and its end is marked dead. Every prefix of a text has
one exact encoding, so a dead end is dead for good, each place is entered once, and the
work is linear in the bytes whatever the text (a run of a million blanks is no harder
than prose). Decoding gathers the bytes of all ids of a batch from one block of bytes by
a table of offsets.

Which tokens may stand side by side is a table of pairs that is filled as pairs come up.
Merges happen in the order of their ranks, so the tokens at a border go through the right
edge of the left token's history and the left edge of the right one's: a pair is
compatible if at no time the two that meet at the border have a merge due before either
is merged inside its own token. Of equal ranks the leftmost goes first.

Texts are read in one pass and nothing is shuffled: a word is encoded once for each
slice of a task (`MEMO_WORDS` remembered words across slices), so neither hot sources nor
groups of copies gather anywhere. A task holds the vocabulary's tables (their size is the
vocabulary's), at most `MEMO_PAIRS` compatible pairs and a slice of rows of about
`SLICE_CHARS` of text, one row at least.

Edge cases: null and empty texts have no tokens; strings of the file's added tokens in a
text are those tokens, as the tokenizers library has it; rows without doc_id are left
out; repeated rows are encoded each; null ids decode to null, ids that no token has to
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weft.llm.bpe import splitter
from weft.llm.common import small_batches, table, texts

MEMO_WORDS, MEMO_PAIRS, SLICE_CHARS = 500_000, 2_000_000, 4_000_000
#: Fixed value: how byte-level tokenizers cut a text where their file says use_regex.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as bytes (None: no such id), the two parts of each (-1: a single byte), the rank of its merge, added tokens."""

    content: list[bytes | None]
    left: list[int]
    right: list[int]
    rank: list[int]
    added: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The alphabet in which byte-level files write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library. What this encoder has no exact way for is an error."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut = file["model"], file["pre_tokenizer"] or {}
    unlike = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    unlike += ["normalizer"] if file.get("normalizer") else []
    unlike += ["post_processor"] if file.get("post_processor") else []
    unlike += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) else []
    unlike += [t["content"] for t in file["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if unlike:
        raise ValueError(f"{path}: not a plain byte-level BPE: {unlike}")
    letter, vocab = byte_letters(), model["vocab"]
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    size = 1 + max([*vocab.values(), *added.values()])
    content: list[bytes | None] = [None] * size
    for text, i in vocab.items():
        content[i] = bytes(map(letter.__getitem__, text))
    left, right, rank = [-1] * size, [-1] * size, [-1] * size
    for k, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        whole = vocab[a + b]
        if rank[whole] >= 0 or max(rank[vocab[a]], rank[vocab[b]]) >= k or any(rank[vocab[x]] < 0 and len(x) > 1 for x in (a, b)):
            raise ValueError(f"{path}: merge {k} gives a token that is there, or takes one that is not")
        left[whole], right[whole], rank[whole] = vocab[a], vocab[b], k
    if {c for c in content if c is not None and len(c) == 1} != {bytes([b]) for b in range(256)}:
        raise ValueError(f"{path}: a byte has no token")
    for text, i in added.items():
        content[i] = bytes(map(letter.__getitem__, text)) if all(c in letter for c in text) else text.encode()
    return Vocabulary(content, left, right, rank, added)


def compatibility(v: Vocabulary) -> Callable[[int, int], bool]:
    """Whether two tokens may stand side by side in an exact encoding."""
    left, right, rank = v.left, v.right, v.rank
    merged = {(a, b): r for a, b, r in zip(left, right, rank, strict=True) if r >= 0}
    known: dict[tuple[int, int], bool] = {}

    def walk(a: int, b: int, due_a: int, due_b: int) -> bool:
        """No border pair merges before rank due_a inside the left token, due_b inside the right one."""
        while True:
            m = merged.get((a, b))
            if m is not None and m < due_a and m <= due_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                a, due_a = right[a], rank[a]
            else:
                b, due_b = left[b], rank[b]

    def fits(a: int, b: int) -> bool:
        got = known.get((a, b))
        if got is None:
            if len(known) >= MEMO_PAIRS:
                known.clear()
            got = known[a, b] = walk(a, b, _NEVER, _NEVER)
        return got

    fits.walk = walk
    return fits


def encoder(v: Vocabulary) -> Callable[[bytes], list[int]]:
    """Exact merges of one pre-token, in time linear in its bytes."""
    import ahocorasick

    fits, walk = compatibility(v), None
    walk = fits.walk
    # a token whose own bytes merge into something else stands in no encoding
    alive = [c is not None and (r < 0 and len(c) == 1 or r >= 0 and walk(a, b, r, r - 1)) for c, a, b, r in zip(v.content, v.left, v.right, v.rank, strict=True)]
    automaton, own = ahocorasick.Automaton(), {}
    for i, c in enumerate(v.content):
        if alive[i]:
            own[c] = i
            automaton.add_word(c.decode("latin-1"), i)
    automaton.make_automaton()
    size = [len(c or b"") for c in v.content]
    shorter = [-1] * len(size)
    for c, i in own.items():
        shorter[i] = next((own[c[:k]] for k in range(len(c) - 1, 0, -1) if c[:k] in own), -1)

    def encode(word: bytes) -> list[int]:
        if word in own:
            return [own[word]]
        n = len(word)
        longest = [-1] * n
        for end, i in automaton.iter(word.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends come in ascending order, so the longest is the last
        dead, out, at, next_ = bytearray(n + 1), [], 0, longest[0] if n else -1
        while at < n:
            while next_ >= 0 and (dead[at + size[next_]] or out and not fits(out[-1], next_)):
                next_ = shorter[next_]
            if next_ >= 0:
                out.append(next_)
                at += size[next_]
                next_ = longest[at] if at < n else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                next_ = shorter[last]
        return out

    return encode


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """Keys and texts of a batch in slices of bounded length."""
    ids, held, chars = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        ids.append(doc_id)
        held.append(text)
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield ids, held
            ids, held, chars = [], [], 0
    if ids:
        yield ids, held


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    v = read_vocabulary(vocabulary_path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, merge = splitter(BYTE_LEVEL), encoder(v)
        special = re.compile("|".join(f"({re.escape(t)})" for t in sorted(v.added, key=len, reverse=True))) if v.added else None
        memo: dict[str, list[int]] = {}

        def pieces(text: str) -> list:
            if special is None or not special.search(text):
                return find(text)
            out, at = [], 0
            for m in special.finditer(text):
                out += find(text[at : m.start()])
                out.append(v.added[m[0]])  # a number stands for an added token among the words
                at = m.end()
            return out + find(text[at:])

        def ids_of(word) -> list[int]:
            if isinstance(word, int):
                return [word]
            got = memo.get(word)
            if got is None:
                got = merge(word.encode("utf-8"))
                if len(word) < 100:  # long words rarely come again and would make the memo large
                    memo[word] = got
            return got

        for batch in batches:
            for keys, held in _slices(batch):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                numbers: dict = defaultdict(count().__next__)
                sequences = [np.fromiter(map(numbers.__getitem__, p), np.int64, len(p)) for p in map(pieces, held)]
                words = list(map(ids_of, numbers))
                length = np.fromiter(map(len, words), np.int64, len(words))
                flat = np.fromiter((i for w in words for i in w), np.int32, int(length.sum()))
                first = np.cumsum(length) - length
                seq = np.concatenate(sequences)
                n = length[seq]
                ends = np.cumsum(n)
                values = flat[np.repeat(first[seq] - (ends - n), n) + np.arange(n.sum())]
                upto = np.concatenate((np.zeros(1, np.int64), ends))[np.cumsum([0, *map(len, sequences)])]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(each, "doc_id long, ids array<int>")


def _by_ids(encoded: DataFrame, vocabulary_path: str, out: str, finish) -> DataFrame:
    content = [c or b"" for c in read_vocabulary(vocabulary_path).content]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.frombuffer(b"".join(content) or b"\0", np.uint8)
        offset = np.concatenate(([0], np.cumsum(list(map(len, content)), dtype=np.int64), [0, 0]))
        start, size = offset[:-2], np.diff(offset)
        size[len(content) :] = 0  # the last place: an id that no token has

        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            bounds = lists.offsets.to_numpy()
            ids = lists.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_numpy(zero_copy_only=False)
            bounds = bounds - bounds[0]
            place = np.where((ids >= 0) & (ids < len(content)), ids, len(content))
            n = size[place]
            ends = np.cumsum(n)
            raw = block[np.repeat(start[place] - (ends - n), n) + np.arange(n.sum())].tobytes()
            cuts = np.concatenate(([0], ends))[bounds].tolist()
            yield finish(batch, ids.astype("<u4").tobytes(), bounds.tolist(), [raw[a:b] for a, b in zip(cuts, cuts[1:])])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(each, out)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def finish(batch, numbers, bounds, raw):
        there = batch.column("ids").is_valid().to_pylist()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.decode("utf-8", "replace") if ok else None for r, ok in zip(raw, there, strict=True)], pa.string())], names=["doc_id", "text"])

    return _by_ids(encoded, vocabulary_path, "doc_id long, text string", finish)


def digests(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for rows (doc_id, ids), null ids as none."""

    def finish(batch, numbers, bounds, raw):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        spans = list(zip(bounds, bounds[1:]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b - a for a, b in spans], pa.int64()), pa.array([sha(numbers[4 * a : 4 * b]) for a, b in spans], pa.string()), pa.array([sha(r.decode("utf-8", "replace").encode()) for r in raw], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _by_ids(encoded, vocabulary_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode(table(spark, sf_dir, "documents"), path), path)
