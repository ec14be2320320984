"""One query per operator: the whole intended table, production parameters, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, decontaminate, html_text, lexical, pii, simhash, spelling, token_counts, token_output, topk, toxicity, url_filter, warc
from pairloom.llm.common import read, scratch_path
from pairloom.llm.vocabulary import MergeTable, rank_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_exact_top_k(spark, d):
    return topk.top_k(read(spark, d, "embeddings"), F.col("key") % 100 == 0, k=10)


@query
def op2_byte_level_bpe(spark, d):
    ranks = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe_digests(bpe.encode(read(spark, d, "documents"), ranks, public_tokenizers.PATTERN))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_simhash(spark, d):
    found = simhash.near_duplicates(read(spark, d, "documents"), radius=3, shingle=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_url_filter(spark, d):
    return url_filter.judge(read(spark, d, "pages"))


@query
def op5_decontamination(spark, d):
    return decontaminate.find_contaminated(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query
def op6_token_ids_orc(spark, d):
    path = scratch_path(spark, "token_ids")
    token_output.write_token_ids(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return token_output.ids_crc32(token_output.read_token_ids(spark, path))


@query
def op7_html_text(spark, d):
    found = html_text.extract(read(spark, d, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_token_counts(spark, d):
    table = MergeTable(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(read(spark, d, "documents"), table, public_tokenizers.PATTERN, limit=512)


@query
def op9_toxicity(spark, d):
    docs = read(spark, d, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, d, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op10_pii(spark, d):
    found = pii.find_pii(read(spark, d, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kind("base", n)).cast("long").alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


@query
def op11_warc(spark, d):
    files = warc.write_warc(read(spark, d, "pages"), scratch_path(spark, "warc"))
    return warc.pages_of(warc.read_warc(files, split_bytes=4 << 20, payloads=False))


@query
def op12_spelling_variants(spark, d):
    return spelling.spelling_variants(read(spark, d, "documents"))


@query
def op13_ranked_search(spark, d):
    return lexical.ranked_search(read(spark, d, "documents"), read(spark, d, "benchmark"), k=10)
