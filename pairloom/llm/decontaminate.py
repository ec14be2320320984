"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; the ignored places may hold anything,
so a substituted word does not hide a passage. The masks are computed from the window
and the share of tokens that must agree: whatever tokens of a window the rule lets
differ, one mask ignores them all. Seeds of the benchmark meet equal seeds
of the documents in a join on (mask, hash). A Bloom filter of the benchmark's seeds,
of bounded size, keeps almost all other document seeds out of that join; it can only
let too many pass. Each hit fixes how passage and document lie against each other, and
the overlap around it is verified token by token.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import first_column, pinned, text_slices, tidied, whole_row
from pairloom.operators.joins import lookup_join

# Masks per window length; more masks let each keep more places.
MOST_MASKS = 4
LEAST_TOKENS = 1
_MOST_PATTERNS = 20_000
_WORD = re.compile(r"\w+")
_CACHE = 200_000
_PROBES = 8
_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 28


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """Token hashes of texts, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def tokens(self, text: str) -> list[int]:
        words, known = _WORD.findall(text.lower()), self.known
        if len(known) > _CACHE:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return [known[w] for w in words]


def _seed_hashes(tokens: np.ndarray, mask: str, table: int) -> np.ndarray:
    """The seed hash at each place where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.full(n, table + 1, np.uint64), 2 * table + 3
    for place, kept in enumerate(mask):
        if kept == "1":
            factor = factor * 0xD1342543DE82EF95 % (1 << 64)
            out += tokens[place:place + n] * np.uint64(factor)
    return _mixed(out)


def covering_masks(window: int, wrong: int) -> list[str]:
    """Masks (1: kept place) of which, wherever ``wrong`` of ``window`` tokens are substituted, one fits a place that keeps none of them.

    All masks keep the same number of places, the largest for which at most ``MOST_MASKS``
    masks do; they are chosen greedily by the substitution patterns that they still miss. For
    a window with too many patterns to list, one unbroken mask does: of ``wrong`` + 1 equal
    stretches of the window, one has no substitution.
    """
    if wrong == 0:
        return ["1" * window]
    unbroken = "1" * max(1, window // (wrong + 1))
    if math.comb(window, wrong) > _MOST_PATTERNS or window > 20:
        return [unbroken]
    patterns = [sum(1 << p for p in places) for places in itertools.combinations(range(window), wrong)]
    for kept in range(window - wrong, len(unbroken), -1):
        masks = []
        for span in range(kept, window + 1):
            for inner in itertools.combinations(range(1, span - 1), kept - 2) if kept > 1 else [()]:
                mask = 1 | sum(1 << p for p in inner) | 1 << (span - 1)
                placed = [mask << shift for shift in range(window - span + 1)]
                masks.append((span, mask, {n for n, pattern in enumerate(patterns) if any(not pattern & p for p in placed)}))
        chosen, missed = [], set(range(len(patterns)))
        while missed and len(chosen) < MOST_MASKS:
            span, mask, met = max(masks, key=lambda m: (len(m[2] & missed), -m[0], m[1]))
            if not met & missed:
                break
            chosen.append("".join("1" if mask >> p & 1 else "0" for p in range(span)))
            missed -= met
        if not missed:
            return chosen
    return [unbroken]


def _wrong(length: int, share: float) -> int:
    """How many of ``length`` tokens may differ when ``share`` of them must agree."""
    return length - math.ceil(share * length - 1e-9)


def _tables(window: int, share: float, short: list[int]) -> list[tuple[int, str, int]]:
    """(number, mask, length of the passages it is for; 0: all of at least ``window`` tokens)."""
    lengths = [(0, window), *[(n, n) for n in short]]
    return [(100 * n + at, mask, n) for n, w in lengths for at, mask in enumerate(covering_masks(w, _wrong(w, share)))]


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered passages with their token hashes as packed bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = _Hasher(), TaskContext.get().partitionId() << 33
        for part in text_slices(batches):
            tokens = [np.array(hasher.tokens(t or ""), "<u8") for t in first_column(part, "text").to_pylist()]
            columns = [pa.array(range(number, number + len(tokens)), pa.int64()), first_column(part, "key"), pa.array([t.tobytes() for t in tokens], pa.binary())]
            number += len(tokens)
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_key", "item_tokens"])

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_key", benchmark.schema[key].dataType), T.StructField("item_tokens", T.BinaryType())])
    return benchmark.select(benchmark[key].alias("key"), benchmark[text].alias("text")).mapInArrow(tidied(run), schema)


def _item_seeds(items: DataFrame, tables: list[tuple[int, str, int]], window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, packed in zip(first_column(batch, "item").to_pylist(), first_column(batch, "item_tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(packed, "<u8")
                for table, mask, length in tables:
                    if length != (len(tokens) if len(tokens) < window else 0):
                        continue
                    hashes = _seed_hashes(tokens, mask, table)
                    n = len(hashes)
                    columns = [pa.array([table] * n, pa.int32()), pa.array(hashes.view(np.int64)), pa.array([item] * n, pa.int64()), pa.array(range(n), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["table", "hash", "item", "item_place"])

    return items.mapInArrow(tidied(run), "table int, hash bigint, item bigint, item_place int")


def _probes(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return (hashes + np.uint64(probe) * step) & np.uint64(bits - 1)


def _bloom(seeds: DataFrame) -> np.ndarray:
    """Bit array of the seeds' hashes: at least 64 bits per seed up to a bound of 32 MB."""
    n = seeds.count()
    bits = _LEAST_BITS
    while bits < 64 * n and bits < _MOST_BITS:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = first_column(batch, "hash").to_numpy().view(np.uint64)
            at = np.concatenate([_probes(hashes, p, bits) for p in range(_PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = seeds.select("hash").mapInArrow(tidied(run), "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    return out.view(np.uint64)


def _passing(hashes: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be benchmark seeds."""
    at = np.arange(len(hashes))
    for probe in range(_PROBES):
        bit = _probes(hashes[at], probe, 64 * len(bloom))
        at = at[(bloom[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def _document_hits(docs: DataFrame, tables: list[tuple[int, str, int]], bloom: np.ndarray, key: str, text: str) -> DataFrame:
    """Documents with seeds that pass the filter: packed tokens and the seeds (table, hash, place)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # at most 32 MB
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits, number = _Hasher(), shared.value, TaskContext.get().partitionId() << 33
        for part in text_slices(batches):
            lists = [hasher.tokens(t or "") for t in first_column(part, "text").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            tokens = np.array([h for x in lists for h in x], np.uint64)
            doc, first = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes
            found = []
            for table, mask, _ in tables:
                hashes = _seed_hashes(tokens, mask, table)
                at = _passing(hashes, bits)
                at = at[doc[at] == doc[at + len(mask) - 1]]
                found.append((np.full(len(at), table), hashes[at], at))
            table, hashes, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(doc[at], kind="stable")
            table, hashes, at = table[order], hashes[order], at[order]
            hit, count = np.unique(doc[at], return_counts=True)
            offsets = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
            columns = [
                pa.array(number + hit), first_column(part, "key").take(pa.array(hit)),
                pa.array([tokens[first[d]:first[d] + sizes[d]].tobytes() for d in hit.tolist()], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(table.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array((at - first[doc[at]]).astype(np.int32))),
            ]
            number += len(lists)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_key", "doc_tokens", "tables", "hashes", "places"])

    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_key", kind), T.StructField("doc_tokens", T.BinaryType()),
        T.StructField("tables", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType())),
    ])
    return docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text")).mapInArrow(tidied(run), schema)


def _best_overlap(same: np.ndarray, window: int, share: float) -> tuple[int, int]:
    """Length and matches of the longest stretch whose every window of ``window`` tokens matches by ``share``;
    (0, 0) if there is none."""
    if len(same) < window:
        return 0, 0
    sums = np.r_[0, np.cumsum(same)]
    good = sums[window:] - sums[:-window] >= share * window
    if not good.any():
        return 0, 0
    edges = np.flatnonzero(np.diff(np.r_[0, good.astype(np.int8), 0]))
    starts, stops = edges[::2], edges[1::2] + window - 1
    best = int(np.argmax(stops - starts))
    return int(stops[best] - starts[best]), int(sums[stops[best]] - sums[starts[best]])


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and passage that overlap: keys, ``n_tokens`` of the longest overlap, ``n_matched`` of them.

    An overlap has at least ``window`` tokens (a shorter passage: all of it) and each
    window in it matches by ``share``; every such overlap is found, wherever its
    substituted tokens stand. Passages of any length count; one without a token overlaps
    nothing, and neither do null and empty texts. Repeated rows with one key give one row
    per key pair; a null key counts as a key; other columns are ignored, whatever their
    names; either table may be empty.
    """
    items = pinned(_items(benchmark, item_key, item_text))
    lengths = items.select((F.octet_length("item_tokens") / 8).cast("int").alias("n")).where(F.col("n").between(LEAST_TOKENS, window - 1)).distinct()
    tables = _tables(window, share, sorted(r["n"] for r in lengths.collect()))  # fewer lengths than the window
    seeds = pinned(_item_seeds(items, tables, window).dropDuplicates(["table", "hash", "item", "item_place"]))
    hits = pinned(_document_hits(docs, tables, _bloom(seeds), key, text))
    flat = hits.select("row", F.explode(F.arrays_zip("tables", "hashes", "places")).alias("x")).select("row", F.col("x.tables").alias("table"), F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    met = lookup_join(flat, seeds, ["table", "hash"], spread_by=["row", "place"])
    pairs = met.select("row", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    # The part of the document beside the passage, 8 bytes a token.
    laid = lookup_join(pairs, items, "item", spread_by=["row", "shift"]).join(hits.select("row", "doc_key", "doc_tokens"), "row")
    length = (F.octet_length("item_tokens") / 8).cast("int")
    from_item = F.greatest(-F.col("shift"), F.lit(0))
    beside = F.expr("substring(doc_tokens, greatest(shift, 0) * 8 + 1, (octet_length(item_tokens) div 8 - greatest(-shift, 0)) * 8)")
    laid = laid.select("doc_key", "item_key", "item_tokens", length.alias("n"), from_item.alias("skip"), beside.alias("beside"))
    kinds = {f.name: f.dataType for f in laid.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, matched = [], []
            columns = [first_column(batch, c) for c in ("item_tokens", "skip", "beside", "n")]
            for i in range(batch.num_rows):
                item, skip, doc, n = (c[i].as_py() for c in columns)
                doc = np.frombuffer(doc, "<u8")
                same = np.frombuffer(item, "<u8")[skip:skip + len(doc)] == doc
                a, b = _best_overlap(same, min(window, n), share)
                size.append(a)
                matched.append(b)
            yield pa.RecordBatch.from_arrays([first_column(batch, "doc_key"), first_column(batch, "item_key"), pa.array(size, pa.int32()), pa.array(matched, pa.int32())], names=[key, "item", "n_tokens", "n_matched"])

    schema = T.StructType([T.StructField(key, kinds["doc_key"]), T.StructField("item", kinds["item_key"]), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_matched", T.IntegerType())])
    checked = laid.mapInArrow(tidied(run), schema).where("n_tokens > 0").withColumnRenamed("item", item_key)
    best = checked.groupBy(key, item_key).agg(F.max(F.struct("n_tokens", "n_matched")).alias("best"))
    return best.select(key, item_key, "best.n_tokens", "best.n_matched")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that overlap a passage; rows that share a key go together; all columns stay, whatever their names."""
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"), whole_row(docs))
    found = pinned(find_contaminated(rows, benchmark, key="key", text="text", **options).select("key").distinct())
    bare = found.where(F.col("key").isNull()).isEmpty()
    kept = lookup_join(rows.drop("text"), found.where(F.col("key").isNotNull()), "key", "left_anti", spread_by=["row"])
    return (kept if bare else kept.where(F.col("key").isNotNull())).select("row.*")
