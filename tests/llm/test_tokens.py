"""Token operators against the public libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import bpe, token_counts, token_output
from pairloom.llm.vocabulary import MergeTable, rank_file
from pairloom.session import scratch_path

RANKS = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TABLE = MergeTable(public_tokenizers.path("byte_bpe_50k.json"))

TEXTS = [
    "", None, " ", "  \n ", "a", "The cat's 12 hats, won't!  x\n\n y", " a   b \n c  ", "x\x1c y\x85 z\xa0q", "\x1f \x1f a",
    "éÀß ΑΣ İi ſ é é", "日本語 テキスト 🎉🎉", "<|endoftext|> a<|endoftext|>b", "<|startoftext|>x", "aaaa" * 500, "ab" * 3000,
    "word!!.. (x) foo's 's", "\t\t a\t b", "a　b᠎c", " ".join(f"w{i}" for i in range(4000)),
]
ROWS = [(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(4, "a", 5, "x"), (None, "no key", 1, None)]
SCHEMA = "doc_id bigint, text string, n_tokens int, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_encode_and_decode_equal_the_library(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = []
    for i, t, _, _ in ROWS:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i if i is not None else -1, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)


def test_small_blocks_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    counts = {r.doc_id: r.n_tokens for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert counts == {i: len(TIKTOKEN.encode_ordinary(t or "")) for i, t, _, _ in ROWS}


def test_decode_on_its_own(spark):
    ids = np.array(TIKTOKEN.encode_ordinary("héllo"), "<u4").tobytes()
    rows = bpe.decode(spark.createDataFrame([(1, bytearray(ids)), (2, bytearray()), (3, None)], "k int, ids binary"), RANKS).orderBy("k").collect()
    assert [None if r.decoded is None else bytes(r.decoded) for r in rows] == ["héllo".encode(), b"", None]


def test_counts_equal_the_library(docs):
    rows = token_counts.count_tokens(docs, TABLE, public_tokenizers.PATTERN, limit=100).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    want = []
    for i, t, _, _ in ROWS:
        n = len(BYTES.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i is not None else -1, len((t or "").encode()), n, n > 100))
    assert got == sorted(want)


def _library(text):
    return [*WORDS.encode(text or "", add_special_tokens=False).ids, 2]


def test_orc_round_trip(spark, docs):
    path = scratch_path(spark, "orc")
    token_output.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    back = token_output.read_token_ids(spark, path)
    rows = back.orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, *sorted(i for i, *_ in ROWS if i is not None)]
    start, texts = 0, {i: t for i, t, *_ in ROWS}
    for r in rows:
        assert (r.start, r.n_tokens, r.ids) == (start, len(r.ids), _library(texts[r.doc_id]))
        start += r.n_tokens
    sums = {r.start: r.ids_crc32 for r in token_output.ids_crc32(back).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}


def test_files_are_orc_with_bloom_filters(spark, docs):
    path = scratch_path(spark, "orc")
    token_output.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    assert spark.read.orc(path).where("doc_id = 7").count() == 1
    file = spark.read.orc(path).inputFiles()[0]
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(
        spark._jvm.org.apache.hadoop.fs.Path(file), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getCompressionKind().toString() == "ZSTD" and reader.getRowIndexStride() == 10000
    reader.close()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, TABLE, public_tokenizers.PATTERN).count() == 0
    path = scratch_path(spark, "orc")
    token_output.write_token_ids(none, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    assert token_output.read_token_ids(spark, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab eE'sS.,!\n\t 1²é́ΣσİẞЖ中🎉\xa0\x1c\x85　<|>")), max_size=40), max_size=5))
def test_any_text_counts_and_encodes_like_the_library(texts):
    counter = token_counts._Counter(TABLE, public_tokenizers.PATTERN)
    assert counter.count(texts) == [len(BYTES.encode(t, add_special_tokens=False).ids) for t in texts]
    encoder = token_output.WordEncoder(WORDS.to_str())
    assert [np.frombuffer(e, "<i4").tolist() for e in encoder.encode(texts)] == [_library(t)[:-1] for t in texts]
