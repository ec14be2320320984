"""SimHash near-duplicates by covering locality-sensitive hashing.

A mask table keeps those bits of a fingerprint whose code has odd overlap with the
table's number. Bit codes and table numbers are the non-zero vectors of r + 1 bits;
any r differing bits span at most r dimensions, so some table number is orthogonal to
all their codes: in that table both fingerprints have the same key. Hence every pair
within radius r collides in at least one of the 2^(r+1) - 1 tables, for certain.

Equal fingerprints are one node. A bucket of many different fingerprints is cut into
blocks of bounded size, and each pair of blocks is compared in a task of its own; it
passes on one link per fingerprint to its group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import first_column, pinned, text_slices, tidied, whole_row
from pairloom.llm.components import components
from pairloom.operators.joins import lookup_join

BITS = 64
SEED = 42
_HASHES = 1 << 16
_BLOCK = 512
_PAIRS = 1 << 21


def _majority(words: list[bytes], shingle: int, seed: int) -> int:
    """The fingerprint of one word sequence: bits set in over half of its shingles' hashes."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _HASHES):
        stop = min(n, start + _HASHES)
        hashes = np.array([digest(b" ".join(words[i:i + shingle]), seed) for i in range(start, stop)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` (long) of each whole text.

    A-Z become lower case, words are cut at ASCII white space, shingles count with
    repeats. A text with fewer words than a shingle is one shingle; a null text or one
    without words has fingerprint 0. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = first_column(part, "text").to_pylist()
            found = [_majority((t or "").encode().lower().split(), shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([first_column(part, "key"), pa.array(found, pa.int64())], names=[key, "fingerprint"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(tidied(run), schema)


def covering_masks(radius: int) -> list[int]:
    """The bit masks of the tables, as signed 64-bit numbers."""
    tables = (1 << (radius + 1)) - 1
    masks = []
    for table in range(1, tables + 1):
        mask = sum(1 << bit for bit in range(BITS) if ((bit % tables + 1) & table).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _linked(group: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the first node of its linked set, per group; rows are sorted by group."""
    left, right = [], []
    for step in range(1, len(node)):
        at = np.flatnonzero(group[step:] == group[:-step])
        if not len(at):
            break
        near = at[np.bitwise_count(node[at] ^ node[at + step]) <= radius]
        left.append(near)
        right.append(near + step)
    if not left:
        return node[:0], node[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(node)))
    return node[moved], node[label[moved]]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (``a``, ``b``) that join all ``fingerprint`` values within ``radius`` bits, directly or in steps.

    ``nodes`` holds each fingerprint once. Every link joins fingerprints of one group;
    a bucket of n fingerprints yields fewer than n links per pair of blocks.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("bigint").alias("m")) for i, m in enumerate(covering_masks(radius))])
    spread = nodes.select("fingerprint", F.explode(masks).alias("x"))
    keyed = spread.select("fingerprint", F.col("x.t").alias("t"), F.col("fingerprint").bitwiseAND(F.col("x.m")).alias("k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    # Only fingerprints that share a bucket go on.
    shared = lookup_join(keyed, pinned(sizes), ["t", "k"], spread_by=["fingerprint"])
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("blocks")).cast("int")
    placed = shared.withColumn("blocks", blocks).withColumn("own", own)
    meet = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = meet.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if not held:
                return
            group = np.concatenate([g for g, _ in held])
            node = np.concatenate([f for _, f in held])
            held.clear()
            sizes = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]))
            ends = np.cumsum(sizes)
            start = work = 0
            for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                work += size * size
                if work > _PAIRS or end == len(group):
                    a, b = _linked(group[start:end], node[start:end], radius)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    start, work = end, 0

        last, number = None, 0
        for batch in batches:
            parts = [first_column(batch, c).to_numpy(zero_copy_only=False) for c in ("t", "k", "i", "j")]
            node = first_column(batch, "fingerprint").to_numpy(zero_copy_only=False)
            if not len(node):
                continue
            change = np.zeros(len(node), bool)
            for p in parts:
                change[1:] |= p[1:] != p[:-1]
            first = tuple(p[0] for p in parts)
            change[0] = last is not None and first != last
            last = tuple(p[-1] for p in parts)
            group = number + np.cumsum(change)
            number = int(group[-1])
            # Groups before the batch's last one are whole; the last may go on in the next batch.
            cut = int(np.searchsorted(group, number))
            if cut:
                held.append((group[:cut], node[:cut]))
            if cut or change[0]:
                yield from flush()
            held.append((group[cut:], node[cut:]))
        yield from flush()

    dealt = grouped.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fingerprint")
    return dealt.mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id``, the smallest key reachable over links of at most ``radius`` bits.

    One row per row of ``docs``: repeated rows repeat. A row with a null key gets the
    component of its fingerprint, null if no key is known there. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    if key in ("fingerprint", "component_id"):
        raise ValueError(f"the key column must have another name than {key}: the result has a column of that name")
    printed = pinned(fingerprints(docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text")), shingle, seed, "key", "text"))
    nodes = pinned(printed.groupBy("fingerprint").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fingerprint"), radius))
    of_node = nodes.join(roots, nodes.fingerprint == roots.node, "left")
    root = F.coalesce("root", "fingerprint")
    # Only fingerprints that are linked or shared need the table; any other document is its own component.
    grouped = of_node.where(F.col("root").isNotNull() | (F.col("n") > 1)).select("fingerprint", "first", root.alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    table = pinned(grouped.select("fingerprint", "root").join(lowest, "root").select("fingerprint", "component_id", F.lit(True).alias("grouped")))
    joined = lookup_join(printed, table, "fingerprint", "left", spread_by=["key"])
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), "fingerprint", component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest key.

    Rows that share a key are one document, of which one row stays. Rows without a key
    stay if no document with a key is in their group. All columns stay, whatever their names.
    """
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"), whole_row(docs))
    found = pinned(near_duplicates(rows, radius, shingle, seed, "key", "text"))
    keyed = found.where("key is not null").groupBy("key").agg(F.min(F.col("component_id") != F.col("key")).alias("drop"), F.count("*").alias("n"))
    special = pinned(keyed.where("drop or n > 1"))
    unkeyed = found.where("key is null and component_id is not null").select("fingerprint").distinct()
    named = rows.where("key is not null").select("key", "row")
    plain = lookup_join(named, special.select("key"), "key", "left_anti", spread_by=["row"])
    repeated = lookup_join(named, special.where("not drop").select("key"), "key", "left_semi", spread_by=["row"]).dropDuplicates(["key"])
    kept = plain.select("row.*").unionByName(repeated.select("row.*"))
    bare = rows.where("key is null")
    if bare.isEmpty():
        return kept
    marked = bare.select("row", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    lost = fingerprints(marked, shingle, seed, "mark", "text").distinct().join(unkeyed, "fingerprint", "left_semi").select("mark")
    return kept.unionByName(marked.join(lost, "mark", "left_anti").select("row.*"))
