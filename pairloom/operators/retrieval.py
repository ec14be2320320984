"""Vector lookup, mean similarities, top-k retrieval and full ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import blend, cosine, unit
from pairloom.operators.joins import BROADCAST_BYTES, frame_bytes, lookup_join, salted_join
from pairloom.operators.ordering import top_k, with_position
from pairloom.session import pinned

_QUERY_BLOCK, _ITEM_BLOCK = 1024, 2048
# Size of the queries' values up to which every task holds them all, and of a cell of items beyond it.
QUERY_BYTES, CELL_BYTES = 32 << 20, 64 << 20
_ASKED_ITEMS = 10_000
# Scores closer than this many decimals are ties; the item id decides then.
_SCORE_DECIMALS = 12


def last_vectors(vectors: DataFrame, order: str) -> DataFrame:
    """(key, vec): of duplicate keys the row that comes last in ``order``."""
    return vectors.groupBy("key").agg(F.max_by("vec", order).alias("vec"))


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str, order: str, spread_by: list[str]) -> DataFrame:
    """Rows that have a vector under ``key``, with it in column ``vec``."""
    unique = last_vectors(vectors, order).withColumnRenamed("key", key)
    return lookup_join(rows, unique, key, "inner", spread_by=spread_by)


def lookup_misses(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """One row ``misses``: how many rows have no vector. Rows are counted per key first."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("_n"))
    known = vectors.select(F.col("key").alias(key)).distinct()
    return per_key.join(known, key, "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("misses"))


def blended(first: DataFrame, second: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(key, vec): ``alpha * first + (1 - alpha) * second`` of the vectors both tables have."""
    other = second.select("key", F.col("vec").alias("_other"))
    return first.join(other, "key").select("key", blend("vec", "_other", alpha).alias("vec"))


def mean_paired_cosine(pairs: DataFrame) -> DataFrame:
    """One row ``similarity`` over (a, b)."""
    return pairs.agg(F.avg(cosine("a", "b")).alias("similarity"))


def mean_unpaired_cosine(pairs: DataFrame) -> DataFrame:
    """One row ``similarity``: the mean cosine of a_i and b_j over all i <> j.

    Sum over i <> j of u_i.v_j = (sum of u).(sum of v) - sum of u_i.v_i for unit
    vectors, so only one sum per dimension leaves a task; NULL below two rows.
    """
    units = pairs.select(unit("a").alias("u"), unit("b").alias("v"))
    per_dim = units.select(F.posexplode(F.arrays_zip("u", "v")).alias("d", "x")).groupBy("d").agg(
        F.sum("x.u").alias("u"), F.sum("x.v").alias("v"),
        F.sum(F.col("x.u") * F.col("x.v")).alias("same"), F.count("*").alias("n"),
    )
    n = F.max("n")
    cells = n.cast("double") * (n - 1)
    return per_dim.agg(
        F.try_divide(F.sum(F.col("u") * F.col("v")) - F.sum("same"), cells).alias("similarity")
    )


def _unit_matrix(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)


def _ids(names: pa.Array) -> np.ndarray:
    return names.to_numpy(zero_copy_only=False) if pa.types.is_integer(names.type) else np.array([*names.to_pylist(), None], object)[:-1]


def _products(items: pa.Array, vectors: pa.Array, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, item ids, scores) of blocks of queries and items of bounded size."""
    for start in range(0, len(items), _ITEM_BLOCK):
        ids, units = _ids(items.slice(start, _ITEM_BLOCK)), _unit_matrix(vectors.slice(start, _ITEM_BLOCK))
        for first in range(0, len(matrix), _QUERY_BLOCK):
            yield first, ids, np.round(matrix[first:first + _QUERY_BLOCK] @ units.T, _SCORE_DECIMALS)


# What a task does with the scores: takes the queries, then every batch of items, then ends.
Consumer = Callable[[pa.Table], tuple[Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]]


def _against_all(queries: DataFrame, corpus: DataFrame, consumer: Consumer, schema: str, max_bytes: int | None) -> DataFrame:
    """Every query against every item, in one plan of fixed size.

    Queries of at most ``max_bytes`` (default: ``QUERY_BYTES``), measured, travel to the
    tasks that read the items. More queries form parts of about that size and items form
    cells; each part meets each cell in a task of its own, so neither side is ever whole
    in one place.
    """
    limit = QUERY_BYTES if max_bytes is None else max_bytes
    queries = pinned(queries)
    items = corpus.select("item", F.col("vec").cast("array<double>").alias("vec"))
    held = frame_bytes(queries)
    if held <= limit:
        shared = corpus.sparkSession.sparkContext.broadcast(queries.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take, end = consumer(shared.value)
            for batch in batches:
                yield from take(batch.column(0), batch.column(1))
            yield from end()

        return items.mapInArrow(run, schema)
    parts = max(1, -(-held // max(limit, 1)))
    cells = max(1, -(-frame_bytes(items) // CELL_BYTES))
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).alias("_part")
    cell = F.pmod(F.xxhash64("item"), F.lit(cells)).alias("_cell")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = queries.select(part, numbers(cells).alias("_cell"), *queries.columns)
    right = items.select(numbers(parts).alias("_part"), cell, "item", "vec")

    empty = corpus.sparkSession.createDataFrame([], schema).toArrow().schema

    def meet(asked: pa.Table, some: pa.Table) -> pa.Table:
        take, end = consumer(asked.drop_columns(["_part", "_cell"]).combine_chunks())
        out = [b for batch in some.select(["item", "vec"]).to_batches() for b in take(batch.column(0), batch.column(1))]
        out.extend(end())
        return pa.Table.from_batches(out) if out else empty.empty_table()

    return left.groupBy("_part", "_cell").cogroup(right.groupBy("_part", "_cell")).applyInArrow(meet, schema)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.col("vec").cast("array<double>").alias("vec"))


def _fields(queries: DataFrame, corpus: DataFrame) -> str:
    return (f"query {queries.schema['query'].dataType.simpleString()}, "
            f"item {corpus.schema['item'].dataType.simpleString()}, score double")


def cosine_scores(queries: DataFrame, corpus: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(query, item, score) of every query with every item."""
    def consumer(asked: pa.Table):
        names, matrix = asked.column("query").combine_chunks(), _unit_matrix(asked.column("vec").combine_chunks())

        def take(items: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(items), _ITEM_BLOCK):
                some = items.slice(start, _ITEM_BLOCK)
                for first, _, scores in _products(some, vectors.slice(start, _ITEM_BLOCK), matrix):
                    of = np.repeat(np.arange(first, first + len(scores)), len(some))
                    each = some.take(pa.array(np.tile(np.arange(len(some)), len(scores))))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), each, pa.array(scores.reshape(-1))], names=["query", "item", "score"])

        return take, lambda: iter(())

    return _against_all(_asked(queries), corpus, consumer, _fields(queries, corpus), max_bytes)


class _Best:
    """Each query's best ``k`` items of the batches seen so far: (query, score, item) in three arrays."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = slice(first, first + len(scores))
        least = self.least[rows]
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        query, at = np.nonzero(scores >= least[:, None])
        if not len(query):
            return
        others = (self.query < first) | (self.query >= rows.stop)
        query_all = np.r_[self.query[~others], query + first]
        score_all = np.r_[self.score[~others], scores[query, at]]
        item_all = ids[at] if self.item is None else np.concatenate([self.item[~others], ids[at]])
        order = np.lexsort((np.unique(item_all, return_inverse=True)[1], -score_all, query_all))
        query_all, score_all, item_all = query_all[order], score_all[order], item_all[order]
        place = np.arange(len(order)) - np.searchsorted(query_all, query_all)
        kept = place < self.k
        full = place == self.k - 1
        self.least[query_all[full]] = score_all[full]
        self.query, self.score = np.r_[self.query[others], query_all[kept]], np.r_[self.score[others], score_all[kept]]
        self.item = item_all[kept] if self.item is None else np.concatenate([self.item[others], item_all[kept]])


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 20, max_bytes: int | None = None) -> DataFrame:
    """(query, item, score, rank): the ``k`` nearest items of each query by cosine.

    ``queries``: (query, vec); ``corpus``: (item, vec). A task scores its items by matrix
    products and passes on ``k`` rows per query, never all scores.
    """
    def consumer(asked: pa.Table):
        names, matrix = asked.column("query").combine_chunks(), _unit_matrix(asked.column("vec").combine_chunks())
        best, kind = _Best(len(names), k), None

        def take(items: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            kind = items.type
            for first, ids, scores in _products(items, vectors, matrix):
                best.add(first, ids, scores)
            return iter(())

        def end() -> Iterator[pa.RecordBatch]:
            if len(best.query):
                found = [names.take(pa.array(best.query)), pa.array(best.item.tolist(), kind), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(found, names=["query", "item", "score"])

        return take, end

    return top_k(_against_all(_asked(queries), corpus, consumer, _fields(queries, corpus), max_bytes), "query", "score", "item", k)


def ranks_of(asked: DataFrame, queries: DataFrame, corpus: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(query, item, score, rank) of the asked (query, item) pairs: the 0-based rank of the item among all items, ties by item.

    No ranking is built: a task counts its items that come before each asked one, and the
    counts are added up. Pairs whose query or item is unknown give no row; items must be
    distinct.
    """
    vec = F.col("vec").cast("array<double>")
    of_item = lookup_join(asked.select("query", "item").distinct(), corpus.select("item", vec.alias("_item_vec")), "item", "inner", spread_by=["query", "item"])
    both = lookup_join(of_item, queries.select("query", vec.alias("_query_vec")), "query", "inner", spread_by=["query", "item"])
    known = pinned(both.select("query", "item", F.round(cosine("_query_vec", "_item_vec"), _SCORE_DECIMALS).alias("score")))
    # One row per query and lot of its asked items; a lot is bounded, a query's items are not.
    lots = known.groupBy("query").agg(F.ceil(F.count("*") / _ASKED_ITEMS).cast("int").alias("_lots"))
    dealt = lookup_join(known, lots, "query", "inner", spread_by=["item"]).withColumn("_lot", F.pmod(F.xxhash64("item"), F.col("_lots")))
    packed = dealt.groupBy("query", "_lot").agg(F.collect_list(F.struct("item", "score")).alias("_asked"))
    blocks = lookup_join(packed, queries.select("query", vec.alias("vec")), "query", "inner", spread_by=["query", "_lot"]).drop("_lot")

    def consumer(table: pa.Table):
        names, matrix = table.column("query").combine_chunks(), _unit_matrix(table.column("vec").combine_chunks())
        lists = table.column("_asked").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        wanted = lists.flatten()
        items, scores = _ids(wanted.field("item")), wanted.field("score").to_numpy()
        starts, before = np.r_[0, np.cumsum(sizes)], np.zeros(len(wanted), np.int64)

        def take(some: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
            for first, ids, found in _products(some, vectors, matrix):
                for row, line in enumerate(found):
                    span = slice(starts[first + row], starts[first + row + 1])
                    limits, own = scores[span], items[span]
                    ordered = np.sort(line)
                    low, high = np.searchsorted(ordered, limits, "left"), np.searchsorted(ordered, limits, "right")
                    before[span] += len(line) - high
                    for n in np.flatnonzero(high > low):
                        before[span.start + n] += int((ids[line == limits[n]] < own[n]).sum())
                    # The asked item itself never comes before itself, however its score was rounded here.
                    for at, n in zip(*_places(ids, own), strict=True):
                        before[span.start + n] -= int(line[at] > limits[n])
            return iter(())

        def end() -> Iterator[pa.RecordBatch]:
            if len(wanted):
                of = names.take(pa.array(np.repeat(np.arange(len(names)), sizes)))
                yield pa.RecordBatch.from_arrays([of, wanted.field("item"), wanted.field("score"), pa.array(before)], names=["query", "item", "score", "rank"])

        return take, end

    counted = _against_all(blocks, corpus, consumer, f"{_fields(queries, corpus)}, rank bigint", max_bytes)
    return counted.groupBy("query", "item", "score").agg(F.sum("rank").alias("rank"))


def _places(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``ids``, place in ``own``) of the items in both."""
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], own)
    within = np.flatnonzero(at < len(ids))
    hit = within[ids[order[at[within]]] == own[within]]
    return order[at[hit]], hit


def ranked(scored: DataFrame, within: str | None = "query") -> DataFrame:
    """(.., rank): 0-based rank of every item by descending score, ties by item.

    The sort is spread over all tasks even when one query has all the items.
    """
    placed = with_position(scored, [F.desc("score"), F.asc("item")], "rank", within)
    return placed.withColumn("rank", F.col("rank") - 1)


def described(found: DataFrame, descriptions: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach (item, description) to retrieval results.

    The result is the small side: it is broadcast against the descriptions while
    its measured size is within ``max_bytes``. Beyond, both are shuffled, and
    an item that many queries found is spread over tasks.
    """
    found = pinned(found)
    if frame_bytes(found) <= max_bytes:
        return descriptions.join(F.broadcast(found), "item", "inner")
    return salted_join(found, descriptions, ["item"], "inner", spread_by=["query", "rank"])


def all_splits(**splits: DataFrame) -> DataFrame:
    """Union of (id, vec) tables with the split's name in ``split``."""
    every = None
    for name, frame in splits.items():
        named = frame.withColumn("split", F.lit(name))
        every = named if every is None else every.unionByName(named)
    return every
