"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are ordered by range, so files and their stripes hold ascending ids: a
reader prunes files and stripes by their minimum and maximum and by the Bloom
filter, and stripes are read in parallel. Each row keeps its offset in its file;
adding the tokens of the files before it gives its place in the whole sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pairloom.llm.common import first_column, scratch_path, text_slices, tidied
from pairloom.llm.vocabulary import byte_letters

_WORD_CACHE, _TOKEN_CACHE = 300_000, 600_000
_SLICE_BYTES = 8 << 20
# Letters that are their own NFC form and whose lower case does not depend on their neighbours.
_WORD = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u024f]+\\Z")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "orc.bloom.filter.fpp": "0.01",
}


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of whole texts by the library, each distinct word of a slice encoded once and remembered for a while.

    The file's normalizer and splitter never join across white space, so the ids of a
    text are those of its words one after another, and lower-casing A-Z first changes
    none. A word of Latin letters followed by ASCII punctuation is two pre-tokens, which
    are remembered apart and go to the library's model directly; every other word,
    such as one with other white space inside, passes through the whole library.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.library = Tokenizer.from_str(tokenizer)
        self.model = self.library.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes | None] = {}

    def token(self, word: str) -> bytes | None:
        """Ids of a pre-token; None for a word that the whole library must see."""
        if not _WORD.match(word):
            return None
        return self.merge(word if word.isascii() else word.lower())

    def learned(self, words: pa.Array) -> list[bytes]:
        """Ids of each of the distinct words as 32-bit integers."""
        if len(self.words) > _WORD_CACHE:
            self.words.clear()
        if len(self.tokens) > _TOKEN_CACHE:
            self.tokens.clear()
        tokens = self.tokens
        heads = pc.ascii_rtrim(words, _PUNCTUATION)
        coded = heads.dictionary_encode()
        of_head = []
        for head in strings(coded.dictionary):
            if head not in tokens:
                tokens[head] = self.token(head)
            of_head.append(tokens[head])
        found = [of_head[c] for c in coded.indices.to_pylist()]
        longer = np.flatnonzero(pc.binary_length(words).to_numpy() > pc.binary_length(heads).to_numpy())
        for at, word, head in zip(longer.tolist(), strings(words.take(pa.array(longer))), strings(heads.take(pa.array(longer))), strict=True):
            if found[at] is not None:
                tail = word[len(head):]
                if tail not in tokens:
                    tokens[tail] = self.merge(tail)
                found[at] += tokens[tail]
        odd = np.array([at for at, ids in enumerate(found) if ids is None], np.int64)
        names = strings(words.take(pa.array(odd)))
        new = [w for w in names if w not in self.words]
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            for word, code in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.words[word] = array("i", code.ids).tobytes()
        for at, word in zip(odd.tolist(), names, strict=True):
            found[at] = self.words[word]
        return found

    def merge(self, word: str) -> bytes:
        """Ids of one pre-token by the library's model, whose letters stand for bytes."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return array("i", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, ends)[:-1]]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids end); a null text has none."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = split.flatten().dictionary_encode()
        of_distinct = self.learned(words.dictionary)
        ids = np.frombuffer(b"".join(of_distinct), "<i4")
        sizes = np.array([len(x) // 4 for x in of_distinct], np.int64)
        if not len(sizes):
            return ids, np.zeros(len(texts), np.int64)
        codes = words.indices.to_numpy()
        n = sizes[codes]
        ends = np.r_[0, np.cumsum(n)]
        shift = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        offsets = split.offsets.to_numpy()
        return ids[np.repeat(shift, n) + np.arange(ends[-1])], ends[offsets[1:] - offsets[0]]


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``key``, ``file_offset``, ``n_tokens`` and ``ids`` of each whole text in ascending key order.

    ``end_id`` ends each document; a null or empty text has only it. Null keys come
    first. Rows with one key are ordered by the hash of their text; other columns are
    ignored, whatever their names; an empty table writes files without rows. A failed
    task is written again alone; its rows and offsets follow from the rows' order.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()  # a vocabulary of fixed size
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = docs.schema[key].dataType
    width = "<u2" if max(end_id, Tokenizer.from_str(tokenizer).get_vocab_size() - 1) < 1 << 16 else "<i4"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shared.value)
        for part in text_slices(batches, limit=_SLICE_BYTES):
            ids, ends = encoder.flat(first_column(part, "text"))
            # Each text's ids with the end id behind them.
            packed = np.insert(ids.astype(width), ends, end_id).view(np.uint8)
            offsets = np.r_[0, ends + np.arange(1, len(ends) + 1)] * np.dtype(width).itemsize
            column = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([first_column(part, "key"), first_column(part, "hash"), column.cast(pa.binary())], names=["key", "hash", "packed"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = 0
        for part in text_slices(batches, "packed", _SLICE_BYTES):
            packed = first_column(part, "packed")
            sizes = pc.binary_length(packed).to_numpy().astype(np.int64) // np.dtype(width).itemsize
            ends = np.cumsum(sizes)
            ids = np.frombuffer(b"".join(packed.to_pylist()), width).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([first_column(part, "key"), pa.array(offset + ends - sizes), pa.array(sizes), lists], names=[key, "file_offset", "n_tokens", "ids"])
            offset += int(sizes.sum())

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))
    middle = T.StructType([T.StructField("key", kind), T.StructField("hash", T.LongType()), T.StructField("packed", T.BinaryType())])
    # Written once: the range limits are found from the keys alone, and only packed ids are shuffled.
    between = scratch_path(docs.sparkSession, "packed_ids")
    rows.mapInArrow(tidied(encoded), middle).write.option("compression", "zstd").parquet(between)
    packed = docs.sparkSession.read.schema(middle).parquet(between)
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("file_offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    ordered = packed.repartitionByRange("key", "hash").sortWithinPartitions("key", "hash")
    ordered.mapInArrow(tidied(numbered), schema).write.options(**ORC_OPTIONS, **{"orc.bloom.filter.columns": key}).orc(path)


def read_token_ids(spark: SparkSession, path: str, key: str = "doc_id", key_type: T.DataType | None = None) -> DataFrame:
    """The written rows with ``start``, the number of ids of all documents before each one."""
    schema = T.StructType([
        T.StructField(key, key_type or T.LongType()), T.StructField("file_offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = spark.read.schema(schema).orc(path).select("*", part.alias("part"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, whatever the number of documents.
    bases = totals.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "part")
    return joined.select(key, (F.col("base") + F.col("file_offset")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """``rows`` with the CRC-32 of the ids as little-endian unsigned 32-bit integers in place of the ids."""
    kept = [f for f in rows.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = first_column(batch, ids)
            places = lists.offsets.to_numpy().astype(np.int64) * 4
            whole = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            found = [zlib.crc32(whole[a:b]) if ok else None for a, b, ok in zip(places[:-1], places[1:], lists.is_valid().to_pylist(), strict=True)]
            columns = [first_column(batch, f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], names=[*[f.name for f in kept], name])

    return rows.mapInArrow(tidied(run), T.StructType([*kept, T.StructField(name, T.LongType())]))
