"""Skip-gram word vectors with negative sampling, with vocabulary and parameters in tables.

The corpus is read once: every task counts the (word, neighbour) pairs of its sentences,
and the counts are added up. From then on training works on that table of weighted pairs,
kept as packed rows of many pairs. Words are dealt into parts, neighbours into blocks. In
a round the task of a part holds its words' vectors, takes in one block of neighbours
after the other with the pairs of both, and passes on the sums of their gradients; the
task of a block adds those up and moves its rows. No vocabulary, vector or pair passes
the driver, and no task holds more than its part and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.kernels import _lengths, _slices
from pairloom.operators.corpus import MIN_COUNT, VECTOR_SIZE, WINDOW, token_ids, word_counts, word_ids
from pairloom.session import pinned

# Exponent of the counts in the noise distribution, as in the published method.
NOISE_POWER = 0.75
_SLOTS_PER_WORD = 16
_HELD_PAIRS = 1 << 21
# Pairs are counted in so many buckets by their word: a power of two, as the number of parts.
_BUCKET_BITS = 10
_BUCKETS = 1 << _BUCKET_BITS
# Size up to which a task holds vectors of words; a block of neighbours has a 16th of it.
PARAMETER_BYTES = 32 << 20
# Pairs, or numbers of their vectors, that a task works on at a time.
_DRAWS, _HELD_NUMBERS = 1 << 20, 1 << 21
# Rows of parquet are read by row group.
_GROUP_BYTES = 16 << 20

_CHUNK = "part int, block int, place bigint, a binary, b binary, c binary, width int"
_SUMS = "block int, kind int, part int, a binary, b binary, c binary, d binary, loss double, weight double"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as binary values; ``ends`` has where each ends."""
    data = np.ascontiguousarray(values)
    offsets = (np.r_[0, ends] * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _added_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the counts of each, 1 by default."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    sums = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums


def _turned(words: np.ndarray) -> np.ndarray:
    """Ids with their bucket as the highest of their 31 bits, so that keys sort by bucket."""
    return (words & _BUCKETS - 1) << 31 - _BUCKET_BITS | words >> _BUCKET_BITS


def _turned_back(words: np.ndarray) -> np.ndarray:
    return (words & (1 << 31 - _BUCKET_BITS) - 1) << _BUCKET_BITS | words >> 31 - _BUCKET_BITS


def _counted_pairs(ids: DataFrame, window: int) -> DataFrame:
    """(bucket, keys, counts, width): the pairs of :func:`pair_counts`, added up by task in packed rows that are sorted by bucket inside a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            key, n = _added_up(np.concatenate(held))
            held.clear()
            n = _narrow(n)
            bucket = key >> 63 - _BUCKET_BITS
            ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
            width = pa.array(np.full(len(ends), n.itemsize, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1], pa.int32()), _packed(key, ends), _packed(n, ends), width], names=["bucket", "keys", "counts", "width"])

        slices = ((batch.column(0), lo, hi) for batch in batches for lo, hi in _slices(_lengths(batch.column(0))))
        size = 0
        for lists, lo, hi in slices:
            lists = lists.slice(lo, hi - lo)
            words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sentence = np.repeat(np.arange(len(lists)), _lengths(lists))[words > 0]
            words = words[words > 0]
            turned = _turned(words)
            for distance in range(1, min(window, len(words) - 1) + 1):
                for start in range(0, len(words) - distance, _HELD_PAIRS):
                    stop = min(start + _HELD_PAIRS, len(words) - distance)
                    near = sentence[start:stop] == sentence[start + distance:stop + distance]
                    a, b = slice(start, stop), slice(start + distance, stop + distance)
                    held += [turned[a][near] << 32 | words[b][near], turned[b][near] << 32 | words[a][near]]
                    size += 2 * len(held[-1])
                    if size >= _HELD_PAIRS:
                        yield counted()
                        size = 0
        if size:
            yield counted()

    counts = ids.select("ids").mapInArrow(run, "bucket int, keys binary, counts binary, width int")
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartitionById(min(tasks, _BUCKETS), "bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, words, neighbours, counts) of every bucket, sorted; what is held grows with its distinct pairs only."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    at, size, whole = -1, 0, 0

    def merged() -> None:
        key, n = _added_up(np.concatenate(keys), np.concatenate(counts))
        keys[:], counts[:] = [key], [n]

    def done() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        merged()
        (key,), (n,) = keys, counts
        keys.clear(), counts.clear()
        return at, _turned_back(key >> 32), key & (1 << 32) - 1, n

    for batch in batches:
        for row in range(batch.num_rows):
            bucket, key, n, width = (batch.column(i)[row] for i in range(4))
            if bucket.as_py() != at:
                if keys:
                    yield done()
                at, size, whole = bucket.as_py(), 0, 0
            # Copies, since a batch is gone after its turn.
            keys.append(np.frombuffer(key.as_buffer(), np.int64).copy())
            counts.append(np.frombuffer(n.as_buffer(), f"u{width.as_py()}").astype(np.int64))
            size += len(keys[-1])
            if size >= max(_HELD_PAIRS, 2 * whole):
                merged()
                size = whole = len(keys[0])
    if keys:
        yield done()


def pair_counts(ids: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, near, n) of ``ids`` arrays: how often two ids stand at most ``window`` places apart in a sentence; ids below 1 are left out first.

    Tasks add up a bounded number of pairs before the shuffle, which moves packed rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, near, n in _buckets(batches):
            for start in range(0, len(n), _DRAWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[start:start + _DRAWS]) for x in (words, near, n)], names=["word", "near", "n"])

    return _counted_pairs(ids, window).mapInArrow(run, "word bigint, near bigint, n bigint")


def _noise(vocabulary: DataFrame) -> tuple[np.ndarray, int]:
    """The slots of the noise distribution as runs (first slot, first id, slots per word), and the number of slots.

    Every word has a number of slots that grows with its count's power. Ids follow falling
    counts, so words with equally many slots stand together: as many runs as different
    numbers of slots, about the square root of the slots.
    """
    mass = F.pow(F.col("n"), F.lit(NOISE_POWER))
    total, words = vocabulary.agg(F.sum(mass), F.count("*")).first()
    slots = F.greatest(F.lit(1), F.round(mass / F.lit(total or 1.0) * words * _SLOTS_PER_WORD)).cast("bigint")
    runs = vocabulary.select("id", slots.alias("n_slots")).groupBy("n_slots").agg(F.min("id").alias("first"), F.count("*").alias("words"))
    held = np.array(sorted((r[1], r[0], r[2]) for r in runs.collect()), np.int64).reshape(-1, 3)
    sizes = held[:, 1] * held[:, 2]
    return np.stack([np.cumsum(sizes) - sizes, held[:, 0], held[:, 1]]), int(sizes.sum())


def _words_of(slots: np.ndarray, noise: np.ndarray) -> np.ndarray:
    starts, first, each = noise
    run = np.searchsorted(starts, slots, side="right") - 1
    return first[run] + (slots - starts[run]) // each[run]


def _word_at(slot: Column, runs: Broadcast) -> Column:
    """The id of the word that a slot (from 0) belongs to."""
    @F.arrow_udf("bigint")
    def kernel(slots: pa.Array) -> pa.Array:
        return pa.array(_words_of(slots.to_numpy(zero_copy_only=False), runs.value))

    return kernel(slot)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hashed(*columns: np.ndarray | int) -> np.ndarray:
    """Spark's ``xxhash64`` of bigint columns (arrays) and literals (numbers, int or bigint by their size)."""
    turn = lambda x, bits: x << np.uint64(bits) | x >> np.uint64(64 - bits)
    h = np.array([42], np.uint64)
    for c in columns:
        if isinstance(c, int) and -1 << 31 <= c < 1 << 31:
            h = h + _P5 + np.uint64(4) ^ np.uint64(c & (1 << 32) - 1) * np.array([_P1])
            h = turn(h, 23) * _P2 + _P3
        else:
            value = np.array([c], np.int64).view(np.uint64) if isinstance(c, int) else c.astype(np.int64).view(np.uint64)
            h = h + _P5 + np.uint64(8) ^ turn(value * _P2, 31) * _P1
            h = turn(h, 27) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64)


class _Layout:
    """How ``words`` ids from 1 are dealt: by their rest into ``parts``, in stretches of ``each`` into ``blocks``."""

    def __init__(self, words: int, size: int, tasks: int) -> None:
        self.words, self.size = words, size
        wanted = max(2 * tasks, -(-words * size * 8 // max(1, PARAMETER_BYTES)))
        self.parts = 1 << min(_BUCKET_BITS, wanted.bit_length(), max(words, 1).bit_length() - 1)
        self.each = max(1, PARAMETER_BYTES // (16 * 8 * size))
        self.blocks = max(1, -(-words // self.each))
        self.local = np.min_scalar_type(self.each - 1)

    def first(self, block: int) -> int:
        return block * self.each + 1

    def length(self, block: int) -> int:
        return min(self.each, self.words - block * self.each)

    def shared(self, part: int, block: int) -> tuple[int, int, int]:
        """Where the part's words begin in the block (then every ``parts``-th one), where the block's begin in the part, and how many there are."""
        skipped = (part - self.first(block)) % self.parts
        return skipped, (self.first(block) + skipped) // self.parts, max(0, -(-(self.length(block) - skipped) // self.parts))

    def of_part(self) -> int:
        return self.words // self.parts + 1


def _chunks(layout: _Layout, words: np.ndarray, near: np.ndarray, weight: np.ndarray, place: int, width: int) -> pa.RecordBatch:
    """Pairs as a packed row per part and block."""
    part, block = words & layout.parts - 1, (near - 1) // layout.each
    cell = part * layout.blocks + block
    order = np.argsort(cell.astype(np.min_scalar_type(layout.parts * layout.blocks)), kind="stable")
    cell, words = cell[order], words[order]
    ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) + 1
    same = lambda x, kind: pa.array(np.full(len(ends), x, kind))
    columns = [
        pa.array(cell[ends - 1] // layout.blocks, pa.int32()), pa.array(cell[ends - 1] % layout.blocks, pa.int32()), same(place, np.int64),
        _packed(words.astype(np.int32), ends), _packed(((near - 1) % layout.each)[order].astype(layout.local), ends), _packed(weight[order], ends), same(width, np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "place", "a", "b", "c", "width"])


def _pairs(ids: DataFrame, window: int, layout: _Layout) -> DataFrame:
    """The corpus's pairs as chunks: words, neighbours inside their block, counts of ``width`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, words, near, n in _buckets(batches):
            # Words are sorted; a stretch of them may end inside a word.
            for start in range(0, len(n), _HELD_PAIRS):
                stop = start + _HELD_PAIRS
                counts = _narrow(n[start:stop])
                yield _chunks(layout, words[start:stop], near[start:stop], counts, bucket, counts.itemsize)

    return _counted_pairs(ids, window).mapInArrow(run, _CHUNK)


def _mass(pairs: DataFrame) -> DataFrame:
    """(word, total, kinds): the number of a word's pairs, and of its different neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"word": [], "total": [], "kinds": []}
        at, size = -1, 0

        def summed() -> pa.RecordBatch:
            words = np.concatenate(held["word"])
            found, total = _added_up(words, np.concatenate(held["total"]))
            _, kinds = _added_up(words, np.concatenate(held["kinds"]))
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total), pa.array(kinds)], names=list(held))

        for batch in batches:
            for row in range(batch.num_rows):
                place, words, counts, width = (batch.column(i)[row] for i in range(4))
                # Rows of one bucket stand together; any split of them adds up below.
                if held["word"] and (place.as_py() != at or size >= _HELD_PAIRS):
                    yield summed()
                    size = 0
                at = place.as_py()
                words = np.frombuffer(words.as_buffer(), np.int32).astype(np.int64)
                counts = np.frombuffer(counts.as_buffer(), f"u{width.as_py()}").astype(np.int64)
                found, total = _added_up(words, counts)
                held["word"].append(found), held["total"].append(total), held["kinds"].append(_added_up(words)[1])
                size += len(found)
        if held["word"]:
            yield summed()

    parts = pairs.select("place", "a", "c", "width").mapInArrow(run, "word bigint, total bigint, kinds bigint")
    return parts.groupBy("word").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"))


def _drawn(mass: DataFrame, noise: Broadcast, slots: int, negatives: int, seed: int, step: int, layout: _Layout) -> DataFrame:
    """Chunks of drawn neighbours, their weights negative doubles (``width`` 0): as many as a word has different ones, at least ``negatives``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, total, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            wanted = np.maximum(kinds, negatives)
            ends, weight = np.cumsum(wanted), -negatives * total / wanted
            for start in range(0, int(wanted.sum()), _DRAWS):
                at = np.arange(start, min(start + _DRAWS, ends[-1]))
                row = np.searchsorted(ends, at, side="right")
                slot = _hashed(word[row], at - (ends - wanted)[row] + 1, seed, step) % max(slots, 1)
                yield _chunks(layout, word[row], _words_of(slot, noise.value), weight[row], _BUCKETS + int(word[row[0]]), 0)

    # Every task draws for words of few parts, so a chunk has many pairs.
    dealt = mass.repartition(4 * layout.parts, F.pmod("word", F.lit(_BUCKETS))).sortWithinPartitions(F.pmod("word", F.lit(layout.parts)), "word")
    return dealt.select("word", "total", "kinds").mapInArrow(run, _CHUNK)


def _rows(pieces: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _started(spark: SparkSession, layout: _Layout, seed: int) -> DataFrame:
    """A row per block: the two vectors of every word (``a`` own, ``b`` other) and the squares of their steps so far; ``own`` small pseudo-random numbers that follow from id and seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in batch.column(0).to_pylist()):
            ids = layout.first(block) + np.arange(layout.length(block))
            draw = lambda i: _hashed(ids, i, seed) % (1 << 20) / float(1 << 20) - 0.5
            own = np.stack([draw(i) / float(layout.size) for i in range(1, layout.size + 1)], axis=1)
            none = bytes(8 * len(ids))
            yield _rows([(block, -1, -1, own.tobytes(), bytes(own.nbytes), none, none, 0.0, 0.0)], _SUMS)

    tasks = min(layout.blocks, spark.sparkContext.defaultParallelism)
    return spark.range(0, layout.blocks if layout.words else 0, numPartitions=tasks).mapInArrow(run, _SUMS)


def _sent(state: DataFrame, layout: _Layout) -> DataFrame:
    """Chunks for the parts: their words' ``own`` (block -1), and every block's ``other`` (before its pairs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, own, other = (batch.column(i)[row] for i in range(3))
                block = block.as_py()
                own = np.frombuffer(own.as_buffer()).reshape(-1, layout.size)
                for part in range(layout.parts):
                    skipped, at, n = layout.shared(part, block)
                    pieces = [(part, block, -1, other.as_py(), None, None, 0)]
                    if n:
                        pieces.append((part, -1, block, own[skipped::layout.parts].tobytes(), None, None, at))
                    yield _rows(pieces, _CHUNK)

    return state.select("block", "a", "b").mapInArrow(run, _CHUNK)


def _gradients(chunks: DataFrame, layout: _Layout) -> DataFrame:
    """(block, kind, part, a, b, .., loss, weight): the sums ``a`` of gradients and ``b`` of weights, of a part's words in a block (kind 0) or of a block's neighbours (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, most = layout.size, max(1, _HELD_NUMBERS // layout.size)
        part, block, touched, lost = -1, -1, False, [0.0, 0.0]
        own = other = moves = moved = weights = weighed = None
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def step() -> None:
            nonlocal touched, waiting
            if not held:
                return
            word, near, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            touched, waiting = True, 0
            a, b = own.take(word, axis=1), other.take(near, axis=1)
            agree = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->j", a, b), -30, 30)))
            # Weights of drawn pairs are negative: those should score low.
            share = np.where(n > 0, n * (1 - agree), n * agree)
            size_n = np.abs(n)
            lost[0] -= float((size_n * np.log(np.where(n > 0, agree, 1 - agree))).sum())
            lost[1] += float(size_n.sum())
            for i in range(size):
                moves[i] += np.bincount(word, share * b[i], layout.of_part())
                moved[i] += np.bincount(near, share * a[i], len(weighed))
            weights[:] += np.bincount(word, size_n, layout.of_part())
            weighed[:] += np.bincount(near, size_n, len(weighed))

        def of_block() -> Iterator[pa.RecordBatch]:
            step()
            if touched:
                yield _rows([(block, 1, part, np.ascontiguousarray(moved.T).tobytes(), weighed.tobytes(), None, None, 0.0, 0.0)], _SUMS)

        def of_part() -> Iterator[pa.RecordBatch]:
            for b in range(layout.blocks if lost[1] else 0):
                _, at, n = layout.shared(part, b)
                if weights[at:at + n].any():
                    yield _rows([(b, 0, part, np.ascontiguousarray(moves[:, at:at + n].T).tobytes(), weights[at:at + n].tobytes(), None, None, *lost)], _SUMS)
                    lost[:] = [0.0, 0.0]

        for batch in batches:
            for row in range(batch.num_rows):
                to, at, place, a, b, c, width = (batch.column(i)[row] for i in range(7))
                to, at, place, width = to.as_py(), at.as_py(), place.as_py(), width.as_py()
                if to != part or at != block:
                    yield from of_block()
                    touched = False
                    if to != part:
                        if part >= 0:
                            yield from of_part()
                        lost = [0.0, 0.0]
                        own, moves, weights = np.zeros((size, layout.of_part())), np.zeros((size, layout.of_part())), np.zeros(layout.of_part())
                    part, block = to, at
                if at < 0:
                    given = np.frombuffer(a.as_buffer()).reshape(-1, size)
                    own[:, width:width + len(given)] = given.T
                elif place < 0:
                    other = np.ascontiguousarray(np.frombuffer(a.as_buffer()).reshape(-1, size).T)
                    moved, weighed = np.zeros_like(other), np.zeros(other.shape[1])
                else:
                    words = np.frombuffer(a.as_buffer(), np.int32) // layout.parts
                    near = np.frombuffer(b.as_buffer(), layout.local)
                    n = np.frombuffer(c.as_buffer(), f"u{width}" if width else np.float64).astype(np.float64)
                    for start in range(0, len(n), most):
                        held.append((words[start:start + most], near[start:start + most], n[start:start + most]))
                        waiting += len(held[-1][0])
                        if waiting >= most:
                            step()
        yield from of_block()
        if part >= 0:
            yield from of_part()

    return chunks.repartitionById(layout.parts, "part").sortWithinPartitions("part", "block", "place").mapInArrow(run, _SUMS)


def _moved(state: DataFrame, moves: DataFrame, rate: float, layout: _Layout) -> DataFrame:
    """``state`` after a step along the mean gradients, shorter the longer the steps before it were (Adagrad, one number a row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, seen, sums, weights = -1, [], [], [], []

        def done() -> pa.RecordBatch:
            for vector, before, total, weight in zip(vectors, seen, sums, weights, strict=True):
                given = weight > 0
                mean = total[given] / weight[given, None]
                before[given] += (mean * mean).sum(1)
                root = np.sqrt(before[given])
                vector[given] += mean * np.divide(rate, root, out=np.zeros_like(root), where=root > 0)[:, None]
            return _rows([(at, -1, -1, *(x.tobytes() for x in (*vectors, *seen)), 0.0, 0.0)], _SUMS)

        for batch in batches:
            for row in range(batch.num_rows):
                block, kind, part = (batch.column(i)[row].as_py() for i in range(3))
                a, b, c, d = (batch.column(i)[row] for i in range(3, 7))
                if kind < 0:
                    if at >= 0:
                        yield done()
                    at = block
                    vectors = [np.frombuffer(x.as_buffer()).reshape(-1, layout.size).copy() for x in (a, b)]
                    seen = [np.frombuffer(x.as_buffer()).copy() for x in (c, d)]
                    sums, weights = [np.zeros_like(x) for x in vectors], [np.zeros_like(x) for x in seen]
                else:
                    own = slice(layout.shared(part, block)[0], None, layout.parts) if kind == 0 else slice(None)
                    sums[kind][own] += np.frombuffer(a.as_buffer()).reshape(-1, layout.size)
                    weights[kind][own] += np.frombuffer(b.as_buffer())
        if at >= 0:
            yield done()

    tasks = min(layout.blocks, layout.parts)
    return state.unionByName(moves).repartitionById(tasks, "block").sortWithinPartitions("block", "kind", "part").mapInArrow(run, _SUMS)


def _own_vectors(state: DataFrame, layout: _Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(0)[row].as_py()
                own = np.frombuffer(batch.column(1)[row].as_buffer())
                ids = layout.first(block) + np.arange(layout.length(block))
                offsets = np.arange(len(ids) + 1, dtype=np.int32) * layout.size
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(own))], names=["id", "vec"])

    return state.select("block", "a").mapInArrow(run, "id bigint, vec array<double>")


def train_skipgram(
    sentences: DataFrame, vector_size: int = VECTOR_SIZE, window: int = WINDOW, min_count: int = MIN_COUNT, seed: int = 0,
    rounds: int = 10, negatives: int = 5, rate: float = 0.5, row_id: str = "sent_id", losses: list[float] | None = None,
) -> DataFrame:
    """(word, vec) of ``words`` arrays.

    Words with fewer than ``min_count`` occurrences are left out before windows are laid.
    Every round draws ``negatives`` neighbours per word and place in its list anew from the
    noise distribution; they stand for ``negatives`` times the word's pairs. Draws follow
    from ids, seed and round, so a repeated task repeats them. The mean loss of each round
    is appended to ``losses``. Words without a neighbour keep their first vector; a corpus
    without frequent words gives no rows.
    """
    spark = sentences.sparkSession
    counts = pinned(word_counts(sentences).where((F.col("n") >= min_count) & F.col("word").isNotNull()))
    vocabulary = pinned(counts.join(word_ids(counts), "word").select("word", F.col("id").cast("bigint").alias("id"), "n"))
    numbered = token_ids(sentences, vocabulary.select("word", F.col("id").cast("int").alias("id")), F.col("words"), unknown_id=0, row_id=row_id)
    layout = _Layout(vocabulary.count(), vector_size, spark.sparkContext.defaultParallelism)
    pairs = pinned(_pairs(numbered, window, layout), _GROUP_BYTES)
    noise, slots = _noise(vocabulary)
    runs = spark.sparkContext.broadcast(noise)
    mass = pinned(_mass(pairs))
    state = pinned(_started(spark, layout, seed), _GROUP_BYTES)
    for step in range(rounds):
        chunks = pairs.unionByName(_drawn(mass, runs, slots, negatives, seed, step, layout)).unionByName(_sent(state, layout))
        moves = _gradients(chunks, layout)
        if losses is not None:
            moves = pinned(moves, _GROUP_BYTES)
            losses.append(moves.agg(F.sum("loss") / F.sum("weight")).first()[0])
        state = pinned(_moved(state, moves, rate, layout), _GROUP_BYTES)
    return vocabulary.join(_own_vectors(state, layout), "id").select("word", "vec")
