"""Exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums.

Vectors are ordered by descending length and cut into blocks; queries are blocks of
rows too. The block of the longest vectors gives each query a first threshold. A query
block then meets only those blocks whose longest vector could still reach a threshold
(Cauchy-Schwarz on whole vectors). Inside a pair of blocks, vectors are rotated by the
singular vectors of all data, so the first coordinates carry most of a product; the
rest is bounded by the product of the residual lengths, and only candidates whose
bound reaches the threshold get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import first_column, pinned, tidied
from pairloom.operators.ordering import with_position

_QUERY_BLOCK, _BLOCK, _CHUNK = 1024, 8192, 1024
_FLOAT_EXACT = 2.0 ** 53
_LOWEST = -(1 << 63)


def quantised(embeddings: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """``key``, ``ints`` = floor(scale * x), ``dim`` and ``norm`` of the vectors without null or non-finite components.

    Repeated equal rows are one; rows with a null key or vector take no part.
    """
    rows = embeddings.select(embeddings[key].alias("key"), embeddings[vector].alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.where(F.col("key").isNotNull() & F.col("v").isNotNull()).where(finite)
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    norm = F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return usable.select("key", ints.alias("ints")).distinct().select("key", "ints", F.size("ints").alias("dim"), norm.alias("norm"))


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the right singular vectors of all vectors, largest first, from their summed outer products.

    Each task sums one matrix; Spark adds them up cell by cell, and dimension squared
    numbers come back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = first_column(batch, "dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = first_column(batch, "ints").filter(pa.array(dims == dim))
                m = _matrix(some, len(some)).astype(float)
                if dim:
                    total[dim] = total.get(dim, 0) + m.T @ m
        for dim, gram in total.items():
            cells = pa.array(range(dim * dim), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim * dim, pa.int32()), cells, pa.array(gram.reshape(-1))], names=["dim", "cell", "value"])

    sums = vectors.select("dim", "ints").mapInArrow(tidied(run), "dim int, cell bigint, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for dim, cells in sums.groupby("dim"):
        gram = np.zeros(dim * dim)
        gram[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        gram = np.nan_to_num(gram.reshape(dim, dim))
        out[int(dim)] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()
    return out


def _blocks(placed: DataFrame, size: int, number: str, rows: str, extra: list[Column] | None = None) -> DataFrame:
    block = placed.withColumn(number, ((F.col("position") - 1) / size).cast("int"))
    return block.groupBy("dim", number).agg(
        F.max("norm").alias(f"{number}_longest"), F.sort_array(F.collect_list(F.struct("position", "key", "ints", *(extra or [])))).alias(rows))


def _search(pairs: DataFrame, turned: dict[int, np.ndarray], k: int) -> DataFrame:
    """The best ``k`` different candidates of each query row within each pair of blocks."""
    shared = pairs.sparkSession.sparkContext.broadcast(turned)  # dimension squared numbers

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], scores[first]

    def wide(scores: np.ndarray) -> np.ndarray:
        return np.array([min(max(int(s), _LOWEST + 1), -_LOWEST - 1) for s in scores], np.int64)

    def block(query: pa.StructArray, candidate: pa.StructArray, dim: int):
        q_id, c_id = query.field("key").to_numpy(), candidate.field("key").to_numpy()
        q_int, c_int = _matrix(query.field("ints"), len(query)), _matrix(candidate.field("ints"), len(candidate))
        q, c = q_int.astype(float), c_int.astype(float)
        q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        threshold = query.field("threshold").to_numpy(zero_copy_only=False).astype(float)
        exact = q_norm.max(initial=0) * c_norm.max(initial=0) < _FLOAT_EXACT
        axes = shared.value.get(dim, np.zeros((0, 0)))
        head = max(1, dim // 4)
        q_turned, c_turned = q @ axes, c @ axes
        q_rest, c_rest = np.linalg.norm(q_turned[:, head:], axis=1), np.linalg.norm(c_turned[:, head:], axis=1)
        found = [(c_id[:0], np.zeros(0, np.int64))] * len(q)
        for start in range(0, len(c), _CHUNK):
            stop = start + _CHUNK
            slack = 1 + 1e-9 * q_norm * c_norm[start]
            open_rows = np.flatnonzero(q_norm * c_norm[start] + slack >= threshold)
            if not len(open_rows):
                break  # all later vectors are shorter still
            partial = q_turned[open_rows, :head] @ c_turned[start:stop, :head].T + np.outer(q_rest[open_rows], c_rest[start:stop])
            hit = partial + slack[open_rows, None] >= threshold[open_rows, None]
            for row, at in zip(open_rows.tolist(), hit, strict=True):
                at = start + np.flatnonzero(at & (c_id[start:stop] != q_id[row]))
                if len(at):
                    scores = (c[at] @ q[row]).astype(np.int64) if exact else wide(c_int[at].astype(object) @ q_int[row].astype(object))
                    ids, values = found[row]
                    found[row] = best(np.concatenate([ids, c_id[at]]), np.concatenate([values, scores]))
                    if len(found[row][0]) == k:
                        threshold[row] = max(threshold[row], float(found[row][1][-1]))
        place = query.field("position").to_numpy()
        sizes = [len(ids) for ids, _ in found]
        ids = np.concatenate([ids for ids, _ in found]) if found else c_id[:0]
        scores = np.concatenate([values for _, values in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(place, sizes)), pa.array(np.repeat(q_id, sizes)), pa.array(ids), pa.array(scores, pa.int64())], names=["query_row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield block(first_column(batch, "queries").slice(i, 1).flatten(), first_column(batch, "rows").slice(i, 1).flatten(), first_column(batch, "dim")[i].as_py())

    return pairs.select("dim", "queries", "rows").mapInArrow(tidied(run), "query_row bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the ``k`` largest integer inner products of each query.

    ``is_query`` is a condition on column ``key``. Every other row's key is a candidate;
    ties go to the smaller key. Vectors are compared with those of their own length.
    Where a key has several vectors its best score counts. A query without any candidate
    has no row; an empty table gives an empty result; other columns are ignored. A
    product beyond plus or minus the largest long counts as that number.
    """
    vectors = pinned(quantised(embeddings, key, vector, scale))
    turned = rotations(vectors)
    placed = pinned(with_position(vectors, [F.desc("norm"), F.asc("key"), F.asc("ints")], within="dim"))
    blocks = pinned(_blocks(placed, _BLOCK, "block", "rows"))
    asked = vectors.where(is_query)
    asked = pinned(with_position(asked, [F.desc("norm"), F.asc("key"), F.asc("ints")], within="dim"))
    nothing = F.lit(float("-inf"))
    first = _blocks(asked, _QUERY_BLOCK, "query_block", "queries", [nothing.alias("threshold")])
    begun = pinned(_search(first.join(blocks.where("block = 0"), "dim"), turned, k).join(asked.select("dim", F.col("position").alias("query_row"), F.col("key").alias("query_id")), ["query_row", "query_id"]))
    # A query with k candidates in the first block needs at least its k-th score.
    reached = begun.groupBy("dim", F.col("query_row").alias("position")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("threshold"))
    again = asked.join(reached, ["dim", "position"], "left").withColumn("threshold", F.coalesce("threshold", nothing))
    needed = F.when(F.col("norm") > 0, F.col("threshold") / F.col("norm")).otherwise(F.when(F.col("threshold") > 0, F.lit(float("inf"))).otherwise(nothing))
    asking = _blocks(again, _QUERY_BLOCK, "query_block", "queries", [F.col("threshold")])
    least = again.groupBy("dim", ((F.col("position") - 1) / _QUERY_BLOCK).cast("int").alias("query_block")).agg(F.min(needed).alias("least"))
    # Block numbers only: one row per query block and candidate block that can still matter.
    lengths = blocks.groupBy("dim").agg(F.max("block").alias("last"))
    numbers = least.join(lengths, "dim").where("last > 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("last"))))
    useful = numbers.join(blocks.select("dim", "block", "block_longest"), ["dim", "block"]).where(F.col("block_longest") * (1 + 1e-9) + 1 >= F.col("least"))
    pairs = useful.select("dim", "block", "query_block").join(asking, ["dim", "query_block"]).join(blocks.select("dim", "block", "rows"), ["dim", "block"])
    found = begun.select("query_id", "vec_id", "score").unionByName(_search(pairs, turned, k).select("query_id", "vec_id", "score"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
