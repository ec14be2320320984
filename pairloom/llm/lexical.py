"""Ranked lexical search: impact vectors in buckets by length, pruned like inner products.

A document's impact vector has one number per query term, and a score is the inner
product of an item's term counts with it. Every task orders its documents by the
length of their vectors and cuts them into buckets, one row per bucket. The longest
buckets are searched first; the k-th best score so far is an item's threshold:

* Cauchy-Schwarz: a bucket whose longest vector times the item's length stays below
  the threshold is left out. Across tasks the same bound prunes the buckets' table.
* Coordinates: a bucket's largest impact of each term bounds the item's score in it.
* Inside, terms are added from the largest such bound down. Once the rest cannot reach
  the threshold, only documents met so far remain, and of these the ones whose partial
  score plus the bound of their remaining length reaches it.
* Survivors are scored again from their whole vectors in 64-bit integers.

Bounds are doubles, rounded up by a small factor, and a document goes only if its
bound is below the threshold, so ties are kept and the result is exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import first_column, pinned, text_slices, tidied

# In UTF-8, code points from U+0080 on are bytes from 80 on.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
# Item texts of one round; their terms are on the driver and in every task.
ROUND_BYTES = 16 << 20
_BUCKET = 512
_HELD_ENTRIES = 1 << 22
_LEADING_SHARE = 0.95
_SLACK = 1 + 1e-9
_SALTS = 64


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all code points from U+0080 on, with A-Z lower-cased."""
    return _TERM.findall(text.lower())


class Items:
    """Term counts of the items as arrays: one vocabulary, and per item its terms and their counts."""

    def __init__(self, texts: list[list[bytes]]):
        counts = [Counter(t for text in group for t in terms_of(text)) for group in texts]
        self.number = {term: i for i, term in enumerate(sorted(set().union(*counts)))}
        self.terms = [np.array([self.number[t] for t in c], np.int64) for c in counts]
        self.counts = [np.array(list(c.values()), np.int64) for c in counts]


def term_vectors(docs: DataFrame, number: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Per document its key, its count ``n`` of all terms, and the numbers and occurrences of those in ``number``."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(batches):
            totals, sizes, terms, times = [], [0], [], []
            for whole in first_column(part, "text").cast(pa.binary()).to_pylist():
                found = terms_of(whole or b"")
                totals.append(len(found))
                own = [(known[t], n) for t, n in Counter(found).items() if t in known]
                terms.extend([t for t, _ in own])
                times.extend([n for _, n in own])
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([first_column(part, "doc"), pa.array(totals, pa.int64()), *lists], names=["doc", "n", "terms", "times"])

    schema = T.StructType([
        T.StructField("doc", docs.schema[key].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    ])
    return docs.select(docs[key].alias("doc"), docs[text].alias("text")).mapInArrow(tidied(run), schema)


def term_weights(vectors: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term, the number N of documents with terms, and the number L of all terms."""
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per query term.
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    weights = np.zeros(size, np.int64)
    for term, df in zip(held.column("term").to_pylist(), held.column("df").to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return weights, n_docs, n_terms


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], values[offsets[0]:offsets[-1]]


def impacts_of(weights: np.ndarray, terms: np.ndarray, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    times = times.astype(np.int64)
    return weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m))


def norm_buckets(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """One row per bucket: the length of its longest vector, and its documents from the longest vector down."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)
    kind = vectors.schema["doc"].dataType
    schema = T.StructType([
        T.StructField("longest", T.DoubleType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.DoubleType())),
        T.StructField("m", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    ])

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        offsets, terms = flat(first_column(table, "terms"))
        _, times = flat(first_column(table, "times"))
        sizes = np.diff(offsets)
        m = 100 - 75 + 75 * first_column(table, "n").to_numpy() * n_docs // n_terms
        impacts = impacts_of(shared.value, terms, times, np.repeat(m, sizes)).astype(np.float64)
        lengths = np.sqrt(np.add.reduceat(impacts * impacts, offsets[:-1]))
        order = np.argsort(-lengths, kind="stable")
        for start in range(0, len(order), _BUCKET):
            rows = order[start:start + _BUCKET]
            part = table.take(pa.array(rows))
            lists = {
                "docs": first_column(part, "doc"), "lengths": pa.array(lengths[rows]), "m": pa.array(m[rows]), "sizes": pa.array(sizes[rows].astype(np.int32)),
                "terms": first_column(part, "terms").flatten(), "times": first_column(part, "times").flatten(),
            }
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()]
            yield pa.RecordBatch.from_arrays([pa.array([lengths[rows[0]]]), *columns], names=["longest", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            entries += len(first_column(batch, "terms").flatten())
            if entries >= _HELD_ENTRIES:
                yield from cut(held)
                held, entries = [], 0
        if held:
            yield from cut(held)

    return vectors.where(F.size("terms") > 0).mapInArrow(tidied(run), schema)


class Bucket:
    """A bucket's vectors by document and by term."""

    def __init__(self, row: dict[str, pa.Array], weights: np.ndarray):
        self.docs, self.lengths = row["docs"], row["lengths"].to_numpy()
        sizes, self.terms = row["sizes"].to_numpy().astype(np.int64), row["terms"].to_numpy().astype(np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.doc_of = np.repeat(np.arange(len(sizes)), sizes)
        self.impacts = impacts_of(weights, self.terms, row["times"].to_numpy(), np.repeat(row["m"].to_numpy(), sizes))
        order = np.argsort(self.terms, kind="stable")
        self.by_term = order
        self.present, first = np.unique(self.terms[order], return_index=True)
        self.first = np.r_[first, len(order)]
        self.largest = np.zeros(len(weights))
        self.largest[self.present] = np.maximum.reduceat(self.impacts[order], first)
        self.place = np.full(len(weights), -1, np.int64)
        self.place[self.present] = np.arange(len(self.present))

    def postings(self, term: int) -> np.ndarray:
        place = self.place[term]
        return self.by_term[self.first[place]:self.first[place + 1]]

    def survivors(self, terms: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
        """The documents (places) whose score may reach the threshold, of those that share a term with the item."""
        bounds = counts * self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rest = np.r_[np.cumsum(bounds[order][::-1])[::-1], 0.0]
        partial, squares = np.zeros(len(self.docs)), np.zeros(len(self.docs))
        met = np.zeros(len(self.docs), bool)
        used = 0
        # A document outside the lists read so far has at most the rest.
        while used < len(order) and (rest[used] * _SLACK >= threshold or used == 0):
            found = self.postings(terms[order[used]])
            doc, impact = self.doc_of[found], self.impacts[found]
            partial[doc] += counts[order[used]] * impact
            squares[doc] += impact.astype(np.float64) ** 2
            met[doc] = True
            used += 1
        left = counts[order[used:]].astype(np.float64)
        remaining = np.sqrt(np.maximum(self.lengths ** 2 * _SLACK - squares, 0)) * math.sqrt(left @ left)
        return np.flatnonzero(met & ((partial + np.minimum(rest[used], remaining)) * _SLACK >= threshold))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``asked`` holds the item's count of every term."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        begin = np.cumsum(sizes) - sizes
        entry = np.arange(sizes.sum()) - np.repeat(begin - self.starts[docs], sizes)
        return np.add.reduceat(asked[self.terms[entry]] * self.impacts[entry], begin)


def searched(buckets: DataFrame, items: Items, weights: np.ndarray, k: int, thresholds: np.ndarray) -> DataFrame:
    """(item, doc, score): of each task and item the k best documents that may be among the best k of all."""
    shared = buckets.sparkSession.sparkContext.broadcast((items.terms, items.counts, weights, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, weights, thresholds = shared.value
        least = thresholds.copy()
        norms = np.sqrt([float(c @ c) for c in counts])
        sizes = np.array([len(t) for t in terms])
        starts, every, times = np.cumsum(sizes) - sizes, np.concatenate(terms), np.concatenate(counts)
        asked = np.zeros(len(weights), np.int64)
        best: dict[int, list[tuple]] = {}
        kind = pa.null()
        for batch in batches:
            kind = first_column(batch, "docs").type.value_type
            for row in range(batch.num_rows):
                held = {name: first_column(batch, name)[row].values for name in ("docs", "lengths", "m", "sizes", "terms", "times")}
                longest = first_column(batch, "longest")[row].as_py()
                if not (norms * longest * _SLACK >= least).any():
                    continue
                bucket = Bucket(held, weights)
                reach = np.add.reduceat(times * bucket.largest[every], starts)
                for item in np.flatnonzero((norms * longest * _SLACK >= least) & (reach * _SLACK >= least) & (reach > 0)).tolist():
                    docs = bucket.survivors(terms[item], counts[item], least[item])
                    if not len(docs):
                        continue
                    asked[terms[item]] = counts[item]
                    scores = bucket.scores(docs, asked)
                    asked[terms[item]] = 0
                    good = (scores > 0) & (scores >= least[item])
                    docs, scores = docs[good], scores[good]
                    keys = bucket.docs.take(pa.array(docs)).to_pylist()
                    merged = best.get(item, []) + [(-s, key is None, key) for s, key in zip(scores.tolist(), keys, strict=True)]
                    # Equal rows compare equal, so a null key is never compared with a value.
                    best[item] = sorted(merged, key=lambda x: x if not x[1] else x[:2])[:k]
                    if len(best[item]) == k:
                        least[item] = max(least[item], -best[item][-1][0])
        if best:
            rows = [(item, key, -score) for item, found in best.items() for score, _, key in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc", "score"])

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", buckets.schema["docs"].dataType.elementType), T.StructField("score", T.LongType())])
    return buckets.mapInArrow(tidied(run), schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, the best k of each item; a first pass by salt keeps an item's candidates of all tasks out of one task."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(_SALTS)))
    kept = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("salt")


def ranked_round(docs: DataFrame, texts: list[list[bytes]], k: int, key: str, text: str) -> DataFrame:
    """(item, doc, score, rank) for the items whose texts are given, by their place; every item has a term."""
    items = Items(texts)
    vectors = pinned(term_vectors(docs, items.number, key, text))
    weights, n_docs, n_terms = term_weights(vectors, len(items.number))
    buckets = pinned(norm_buckets(vectors, weights, n_docs, n_terms))
    edge = buckets.agg(F.percentile_approx("longest", _LEADING_SHARE)).first()[0] or 0.0
    leading = pinned(searched(buckets.where(F.col("longest") >= edge), items, weights, k, np.zeros(len(texts), np.int64)))
    thresholds = np.zeros(len(texts), np.int64)
    # One row per item of the round.
    for item, score in best_of(leading, k).where(F.col("rank") == k).select("item", "score").collect():
        thresholds[item] = score
    norms = np.sqrt([float(c @ c) for c in items.counts])
    least = float((thresholds / norms).min()) / _SLACK
    rest = searched(buckets.where((F.col("longest") < edge) & (F.col("longest") >= least)), items, weights, k, thresholds)
    return best_of(leading.unionByName(rest), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents with a score above 0 of each item, from all whole texts: (item, rank, key, score).

    Equal scores rank by ascending key, null keys last; every row of ``docs`` is a document
    of its own, repeated rows too. Equal rows of ``items`` count once and rows with one id
    are one item with the terms of all; a null id is an id. Null and empty texts have no
    terms, so they find nothing and are found by nothing. Other columns are ignored. Items
    are searched in rounds of bounded size, each against all documents.
    """
    spark = docs.sparkSession
    asked = pinned(items.select(items[item].alias("item_id"), items[item_text].cast("binary").alias("text")).where(F.octet_length("text") > 0).distinct())
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, -(-total // ROUND_BYTES))
    found = None
    for n in range(rounds):
        # At most about ROUND_BYTES of item texts.
        held = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == n).toArrow()
        groups: dict[object, list[bytes]] = {}
        for name, one in zip(held.column("item_id").to_pylist(), held.column("text").to_pylist(), strict=True):
            if terms_of(one):
                groups.setdefault(name, []).append(one)
        if not groups:
            continue
        ranked = ranked_round(docs, list(groups.values()), k, key, text)
        names = spark.createDataFrame(list(enumerate(groups)), T.StructType([T.StructField("item", T.LongType()), T.StructField(item, items.schema[item].dataType)]))
        part = ranked.join(F.broadcast(names), "item").select(item, "rank", F.col("doc").alias(key), "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([T.StructField(item, items.schema[item].dataType), T.StructField("rank", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return found
