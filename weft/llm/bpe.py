"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are split into pre-tokens. Documents are taken in blocks of about `block_bytes`
of text; a block numbers its distinct words, most frequent first, and keeps its
documents as sequences of word numbers, which is where positions live. Only distinct
words travel: each block sends them, packed, to buckets by hash. There words arrive
bucket by bucket, each distinct word of the corpus is merged into token ids once, and
the ids go back to the blocks, which put every document together by position. Decoding
is a positional join of the ids with the token-byte table, batch by batch; that table
is the vocabulary and has its size whatever the corpus.

The number of buckets follows the number of input partitions, so a bucket's words stay
bounded, and they are let go of when the next bucket begins. A block has a bounded
size and a frequent word counts once in each block, so neither a hot word nor a hot
source gathers anywhere. The exchange that holds blocks and words is used twice (the
words by bucket, the documents by block) and computed once.

Edge cases: null and empty texts have no tokens; rows without doc_id are left out;
repeated rows are encoded each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import small_batches, table, texts
from weft.llm.packing import pack, pack_parts, unpack, unpack_parts

BLOCK_BYTES = 12_000_000
#: Buckets of words for each input partition, and the least number of them.
BUCKETS_EACH, LEAST_BUCKETS = 16, 64
#: Word numbers in one row of documents, and bytes of results held before rows are sent back to the blocks.
ROW_WORDS, HELD_BYTES = 250_000, 8_000_000
#: Documents of a block that are decoded at once.
SLICE = 256
LATIN_END = 0x250
#: Fixed value: White_Space as Unicode has it; the regex module's \s also takes the four separators 1C to 1F.
_SPACE = r"\p{White_Space}"
_SENT = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_SENT_SQL = "key long, block long, kind int, payload binary"
DOCUMENTS, WORDS = 0, 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _latin(pattern: str) -> str:
    """The pattern for texts below LATIN_END, its Unicode classes written out."""

    def members(name: str) -> str:
        if name == "s":
            return r"\t-\r \x85\xa0"
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(name))

    def expand(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(r"\\p\{(\w+)\}|\\(s)", lambda x: members(x[1] or x[2]), m[0])
        return f"[^{members('s')}]" if m[0] == r"\S" else f"[{members(m[1] or 's')}]"

    return re.sub(r"\[[^\]]*\]|\\p\{(\w+)\}|\\[sS]", expand, pattern)


def splitter(pattern: str):
    """The pre-token finder for a pattern as tokenizer libraries write it; most texts take a quicker way to the same result."""
    import regex

    general = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", r"\P{White_Space}").replace(r"\s", _SPACE)).findall
    latin, beyond = re.compile(_latin(pattern)).findall, re.compile(f"[^\x00-{chr(LATIN_END - 1)}]").search
    return lambda text: general(text) if beyond(text) else latin(text)


def _block_rows(block: int, ids: list[int], sequences: list[np.ndarray], words: list[str], buckets: int) -> Iterator[tuple]:
    """Rows of one block: its documents as word numbers, and its words by bucket."""
    uses = np.bincount(np.concatenate(sequences), minlength=len(words)) if words else np.zeros(0, np.int64)
    order = np.argsort(-uses, kind="stable")
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    row = np.cumsum(sizes) // ROW_WORDS
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(row)) + 1):
        own = np.concatenate([sequences[i] for i in part])
        yield block, block, DOCUMENTS, pack_parts(np.array([ids[i] for i in part], np.int64).tobytes(), pack(sizes[part]), pack(number[own]))
    raw = [words[i].encode("utf-8") for i in order]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in raw), np.int64, len(raw))
    by_bucket = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
    for part in np.split(by_bucket, cuts[1:]) if len(cuts) else []:
        own = [raw[i] for i in part]
        yield -1 - int(bucket[part[0]]), block, WORDS, pack_parts(pack(np.diff(part, prepend=0)), pack(np.fromiter(map(len, own), np.int64, len(own))), b"".join(own))


def pretokens(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """Blocks of documents as word numbers (key: the block) and their distinct words (key: below zero, the bucket)."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task = splitter(pattern), TaskContext.get().partitionId()
        block, size = 0, 0
        ids: list[int] = []
        sequences: list[np.ndarray] = []
        numbers: dict[str, int] = defaultdict(count().__next__)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*_block_rows(task << 24 | block, ids, sequences, list(numbers), buckets), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, _SENT, strict=True)], schema=_SENT)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = find(text)
                ids.append(doc_id)
                sequences.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= block_bytes:
                    yield flush()
                    block, size, ids, sequences, numbers = block + 1, 0, [], [], defaultdict(count().__next__)
        if ids:
            yield flush()

    return texts(docs).mapInArrow(each, _SENT_SQL)


def encode_words(sent: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """For every block, the token ids of its words (key: the block). Rows arrive sorted by bucket, so a word is merged once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        bucket, held, size = None, defaultdict(list), 0

        def flush() -> pa.RecordBatch:
            blocks = pa.array(list(held), pa.int64())
            return pa.RecordBatch.from_arrays([blocks, blocks, pa.array([WORDS] * len(held), pa.int32()), pa.array([b"".join(x) for x in held.values()], pa.binary())], schema=_SENT)

        for b in batches:
            b = b.filter(pa.array(b.column("kind").to_numpy() == WORDS))
            for key, block, payload in zip(*(b.column(c).to_pylist() for c in ("key", "block", "payload")), strict=True):
                if key != bucket:
                    bucket, known = key, {}
                gaps, lengths, letters = unpack_parts(payload)
                ids, at = [], 0
                for end in np.cumsum(unpack(lengths)).tolist():
                    word = letters[at:end]
                    at = end
                    got = known.get(word)
                    if got is None:
                        got = known[word] = merge(word)
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
                out = pack_parts(gaps, pack(sizes), pack(flat))
                held[block].append(out)
                size += len(out)
            if size >= HELD_BYTES:
                yield flush()
                held, size = defaultdict(list), 0
        if held:
            yield flush()

    return sent.sortWithinPartitions("key").mapInArrow(each, _SENT_SQL)


def _assemble(key: tuple, words: pa.Table, block: pa.Table) -> pa.Table:
    """Token ids of a block's documents."""
    numbers, sizes, ids = [], [], []
    for payload in words.column("payload").to_pylist():
        parts = iter(unpack_parts(payload))
        for gaps, n, flat in zip(parts, parts, parts, strict=True):
            numbers.append(np.cumsum(unpack(gaps)))
            sizes.append(unpack(n))
            ids.append(unpack(flat))
    empty = np.zeros(0, np.int64)
    number, size, flat = (np.concatenate([empty, *x]) for x in (numbers, sizes, ids))
    first, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    first[number], length[number] = np.cumsum(size) - size, size
    docs, tokens, values = [empty], [empty], [np.zeros(0, np.int32)]
    for payload in block.column("payload").to_pylist():
        own, counts, seq = unpack_parts(payload)
        counts, seq = unpack(counts), unpack(seq)
        n = length[seq]
        ends = np.cumsum(n)
        values.append(flat[np.repeat(first[seq] - (ends - n), n) + np.arange(n.sum())].astype(np.int32))
        upto = np.concatenate((empty[:1], [0], ends))
        last = np.cumsum(counts)
        tokens.append(upto[last] - upto[last - counts])
        docs.append(np.frombuffer(own, np.int64))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(tokens))))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))
    return pa.table([pa.array(np.concatenate(docs)), lists], schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def _by_blocks(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int, buckets: int | None, assemble: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    buckets = buckets or max(LEAST_BUCKETS, BUCKETS_EACH * docs.rdd.getNumPartitions())
    sent = pretokens(docs, pattern, block_bytes, buckets).repartition("key")
    words = encode_words(sent, read_ranks(ranks_path), pattern)
    # the condition is not deterministic to the optimizer, so it stays above the exchange and the exchange is reused
    documents = sent.where(F.when(F.monotonically_increasing_id() >= 0, F.col("kind")) == DOCUMENTS)
    return words.groupBy("key").cogroup(documents.groupBy("key")).applyInArrow(assemble, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    return _by_blocks(docs, ranks_path, pattern, block_bytes, buckets, _assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, content binary) for rows (doc_id, ids)."""
    return _by_ids(encoded, ranks_path, False)


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for rows (doc_id, ids)."""
    return _by_ids(encoded, ranks_path, True)


_DIGESTS_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _decoder(ranks_path: str, as_digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ranks = read_ranks(ranks_path)
    content = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        content[rank] = token

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes, decimal = pa.array(content, pa.large_binary()), pa.array(map(str, range(len(content))), pa.large_string())
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def joined(ids: pa.Array, side: pa.Array, between) -> pa.Array:
            """Each list's ids joined with a table by position, and put together."""
            begin, end = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
            offsets = pc.subtract(ids.offsets.cast(pa.int64()), begin)
            return pc.binary_join(pa.LargeListArray.from_arrays(offsets, side.take(ids.values.slice(begin, end - begin))), pa.scalar(between, side.type))

        for b in batches:
            ids = b.column("ids")
            whole = joined(ids, token_bytes, b"")
            if as_digests:
                written = joined(ids, decimal, ",")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), pa.array([sha(x.as_buffer()) for x in written], pa.string()), pa.array([sha(x.as_buffer()) for x in whole], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), whole.cast(pa.binary())], names=["doc_id", "content"])

    return each


def _by_ids(encoded: DataFrame, ranks_path: str, as_digests: bool) -> DataFrame:
    small_batches(encoded.sparkSession)
    return encoded.mapInArrow(_decoder(ranks_path, as_digests), _DIGESTS_SQL if as_digests else "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every text, decode the ids, and give digests of both.

    A block's ids are decoded where they are put together, a slice of documents at a time,
    so a task has one Python worker there and no ids leave it.
    """
    import public_tokenizers

    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    decoded = _decoder(ranks_path, True)

    def assemble(key: tuple, words: pa.Table, block: pa.Table) -> pa.Table:
        ids = _assemble(key, words, block)
        return pa.Table.from_batches(decoded(ids.to_batches(max_chunksize=SLICE)), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return _by_blocks(docs, ranks_path, pattern, block_bytes, None, assemble, _DIGESTS_SQL)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
