"""Byte-level BPE by a global shuffle of distinct words, and decoding by a token-byte table.

1. Pre-tokens. Each task cuts its texts into pre-tokens and gives every distinct one
   a number within the task's block of documents (about 16 million characters). The
   block keeps, per document, the numbers in order of position: that is the exploded
   table (document, position, word) with the word replaced by its number and the
   position by its place. This table is written once, bucketed by block.
2. Words. The distinct words of all blocks are shuffled by their hash, so equal words
   of all blocks meet in one task and are encoded there once.
3. Ids return to their block, and each document is put together by position, and its ids are decoded by joining the token-byte table.

A frequent word is one entry per block, however often it occurs, so no key is hot,
and texts never move: the shuffles carry word numbers and distinct words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from pairloom.llm.common import first_column, scratch_path, text_slices, tidied, trimmed
from pairloom.llm.vocabulary import WHITE

BLOCK_CHARS = 16_000_000
BLOCK_WORDS = 300_000
_CACHE = 200_000
_SPLIT = b"\xff"  # never part of UTF-8 text
_RUN = re.compile(r"\s \s|\s \Z")


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart (the high ones are nearly all zero), compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class _Block:
    """Numbers the distinct pre-tokens of one block of documents."""

    def __init__(self, pattern):
        self.pattern = pattern
        self.words: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0

    def codes(self, text: str) -> bytes:
        """The numbers of a text's pre-tokens in order, 4 bytes each."""
        self.chars += len(text)
        if len(self.pieces) > _CACHE:
            self.pieces.clear()
        if _RUN.search(text):
            return self.piece(text)
        # Elsewhere a pre-token ends before every single space.
        first, *rest = text.split(" ")
        known, out = self.pieces, []
        out.append(self.piece(first))
        for part in rest:
            part = " " + part
            code = known.get(part)
            if code is None:
                code = known[part] = self.piece(part)
            out.append(code)
        return b"".join(out)

    def piece(self, text: str) -> bytes:
        words = self.words
        return np.array([words.setdefault(w, len(words)) for w in self.pattern.findall(text)], "<u4").tobytes()


def _pre_tokens(docs: DataFrame, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    """Per block: rows of documents with their word numbers, and rows of distinct words by hash bucket."""
    kind = docs.schema["key"].dataType
    source = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(source)
        names = ["block", "bucket", "keys", "counts", "payload"]
        number = TaskContext.get().partitionId() << 24
        keys_type = pa.list_(key_type)

        def rows(bucket, keys, counts, payload):
            n = len(payload)
            return pa.RecordBatch.from_arrays([
                pa.array([number] * n, pa.int64()), pa.array(bucket, pa.int32()), pa.array(keys, keys_type),
                pa.array(counts, pa.list_(pa.int32())), pa.array(payload, pa.binary()),
            ], names=names)

        def dictionary(block: _Block):
            """Words of a bucket with their numbers in the block."""
            spread: dict[int, list[tuple[bytes, int]]] = {}
            for word, code in block.words.items():
                raw = word.encode()
                spread.setdefault(xxhash.xxh3_64_intdigest(raw) % buckets, []).append((raw, code))
            for bucket, entries in spread.items():
                codes = _packed(np.array([code for _, code in entries]))
                words = zstandard.compress(_SPLIT.join([raw for raw, _ in entries]), 3)
                yield rows([bucket], [None], [None], [len(codes).to_bytes(4, "little") + codes + words])

        block = _Block(compiled)
        for part in text_slices(batches):
            coded = [block.codes(t or "") for t in first_column(part, "text").to_pylist()]
            counts = [len(c) // 4 for c in coded]
            yield rows([None], [first_column(part, "key").to_pylist()], [counts], [_packed(np.frombuffer(b"".join(coded), "<u4"))])
            if block.chars >= block_chars or len(block.words) >= BLOCK_WORDS:
                yield from dictionary(block)
                block, number = _Block(compiled), number + 1
        yield from dictionary(block)

    key_type = to_arrow_type(kind)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType()),
    ])
    return docs.mapInArrow(tidied(run), schema)


def _encode_words(words: DataFrame, ranks, pattern: str) -> DataFrame:
    """Per block and bucket: numbers of the words, numbers of ids and ids; a task encodes each distinct word once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                data = first_column(batch, "payload")[row].as_py()
                size = int.from_bytes(data[:4], "little")
                found = []
                for raw in zstandard.decompress(data[4 + size:]).split(_SPLIT):
                    ids = known.get(raw)
                    if ids is None:
                        ids = known[raw] = tuple(encoder.encode_ordinary(raw.decode()))
                    found.append(ids)
                if len(known) > _CACHE:  # bounds the memory; a word met again later is only encoded again
                    known.clear()
                sizes = _packed(np.array([len(i) for i in found]))
                flat = _packed(np.array([i for ids in found for i in ids]))
                packed = b"".join([size.to_bytes(4, "little"), len(sizes).to_bytes(4, "little"), data[4:4 + size], sizes, flat])
                yield pa.RecordBatch.from_arrays([first_column(batch, "block").slice(row, 1), pa.array([packed])], names=["block", "payload"])

    return words.mapInArrow(tidied(run), "block bigint, payload binary")


def _bytes_of(ids: np.ndarray, table: list[bytes | None]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", block_chars: int | None = None
) -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` and ``decoded`` of each whole text, as the tokenizer library encodes it.

    ``ids`` is binary: the ids as little-endian unsigned 32-bit numbers. ``decoded``
    are the bytes of the ids by the token-byte table. A null or empty text has no ids;
    a null key stays null; each of repeated rows has its own result row; other columns
    are ignored, whatever their names; an empty table gives an empty result. ``docs``
    is read once. A task that puts texts together holds one block of about ``block_chars``
    characters (default: ``BLOCK_CHARS``); smaller blocks take less memory and repeat more words.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = _pre_tokens(docs.select(docs[key].alias("key"), docs[text].alias("text")), pattern, buckets, block_chars or BLOCK_CHARS)
    name = f"pre_tokens_{uuid.uuid4().hex}"
    # Bucketed by block, so that only words and ids are shuffled, not the documents' numbers.
    tokens.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).option("compression", "uncompressed").saveAsTable(name)
    blocks = spark.table(name)
    shared, bytes_of = spark.sparkContext.broadcast(ranks), spark.sparkContext.broadcast(token_bytes(ranks))
    words = blocks.where("bucket is not null").select("block", "bucket", "payload").repartition(buckets, "bucket")
    ids_of = _encode_words(words, shared, pattern)
    parts = blocks.where("bucket is null").select("block", "keys", "counts", "payload")

    def join(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        codes, sizes, flats = [], [], []
        for data in right.column("payload").to_pylist():
            a, b = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
            codes.append(_unpacked(data[8:8 + a]))
            sizes.append(_unpacked(data[8 + a:8 + a + b]).astype(np.int64))
            flats.append(_unpacked(data[8 + a + b:]))
        # Ids of the block's words in the order of the words' numbers.
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        length, start = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        length[code], start[code] = size, np.cumsum(size) - size
        table = bytes_of.value
        for batch in left.to_batches():
            for row in range(batch.num_rows):
                keys, counts = first_column(batch, "keys").slice(row, 1).flatten(), first_column(batch, "counts")[row].as_py()
                word = _unpacked(first_column(batch, "payload")[row].as_py())
                n = length[word]
                ends = np.cumsum(n)
                ids = flat[np.repeat(start[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                cut = np.r_[0, ends][np.r_[0, np.cumsum(counts, dtype=np.int64)]].tolist()
                rows = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(np.diff(cut), pa.int64()), pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()),
                    pa.array([_bytes_of(r, table) for r in rows], pa.binary()),
                ], names=form.names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trimmed()  # what the block before left
        return pa.Table.from_batches(list(join(left, right)), form)

    schema = T.StructType([
        T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
    ])
    form = to_arrow_schema(schema)
    return parts.groupBy("block").cogroup(ids_of.groupBy("block")).applyInArrow(run, schema)


def token_bytes(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The token-byte table: the bytes of each id, one entry per id of the vocabulary, hence small enough to broadcast."""
    table: list[bytes | None] = [None] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its packed ``ids`` in column ``name``, which replaces one of that name.

    Null ids give null, no ids give empty bytes; an id outside the table raises.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    kept = [f for f in encoded.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in text_slices(batches, ids):
            packed = first_column(part, ids).to_pylist()
            out = [None if p is None else _bytes_of(np.frombuffer(p, "<u4"), table) for p in packed]
            yield pa.RecordBatch.from_arrays([*[first_column(part, f.name) for f in kept], pa.array(out, pa.binary())], names=[*[f.name for f in kept], name])

    return encoded.mapInArrow(tidied(run), T.StructType([*kept, T.StructField(name, T.BinaryType())]))
