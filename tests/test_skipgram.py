import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import joins, skipgram


@pytest.fixture(scope="module")
def topics(spark):
    """Sentences about one of two topics: words of a topic stand together."""
    draw = random.Random(4)
    words = {t: [f"{t}{i}" for i in range(8)] for t in "ab"}
    rows = [(n, draw.choices(words["ab"[n % 2]], k=draw.randrange(2, 12))) for n in range(160)]
    rows += [(900, []), (901, None), (902, ["a0"]), (903, ["once", "a0", "a1"]), (904, ["a1", None, "a2"])]
    return spark.createDataFrame(rows, "sent_id long, words array<string>").repartition(3), rows


@pytest.mark.parametrize(("held", "window"), [(1 << 20, 3), (4, 3), (1 << 20, 50)])
def test_pair_counts(spark, monkeypatch, held, window):
    monkeypatch.setattr(skipgram, "_HELD_PAIRS", held)
    draw = random.Random(window)
    rows = [[draw.randrange(6) for _ in range(draw.randrange(15))] for _ in range(30)] + [None, [], [3], [0, 0]]
    df = spark.createDataFrame([(r,) for r in rows], "ids array<int>").repartition(2)
    want = Counter()
    for row in rows:
        known = [i for i in row or [] if i > 0]
        for a in range(len(known)):
            for b in range(a + 1, min(len(known), a + window + 1)):
                want[known[a], known[b]] += 1
                want[known[b], known[a]] += 1
    assert {(r.word, r.near): r.n for r in skipgram.pair_counts(df, window).collect()} == dict(want)


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_loss_falls_and_topics_part(spark, topics, monkeypatch, limit):
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", None, limit))
    losses: list[float] = []
    rounds = 14 if limit else 2
    vecs = skipgram.train_skipgram(topics[0], vector_size=6, window=4, rounds=rounds, seed=3, losses=losses)
    table = {r.word: np.array(r.vec) for r in vecs.collect()}
    counts = Counter(w for _, ws in topics[1] for w in ws or [] if w)
    assert set(table) == {w for w, n in counts.items() if n >= 3} and all(len(v) == 6 for v in table.values())
    assert len(losses) == rounds and losses[-1] < losses[0]
    if limit:
        assert losses[-1] < 0.95 * losses[0]
        # All words share the direction that tells seen from drawn neighbours; the rest tells the topics apart.
        mean = np.mean(list(table.values()), axis=0)
        unit = {w: (v - mean) / np.linalg.norm(v - mean) for w, v in table.items()}
        near = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] == b[0]])
        far = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a[0] < b[0]])
        assert near > far + 0.5


def test_same_seed_same_vectors_and_empty_corpus(spark, topics):
    one, two = ({r.word: r.vec for r in skipgram.train_skipgram(topics[0], 3, 2, rounds=1, seed=5).collect()} for _ in range(2))
    assert one.keys() == two.keys() and all(np.allclose(one[w], two[w], atol=1e-12) for w in one)
    assert skipgram.train_skipgram(topics[0].limit(0), 3, 2, rounds=1).count() == 0


def test_hash_equals_sparks(spark):
    ids = np.array([1, 7, 1 << 40, -3])
    df = spark.createDataFrame([(int(i), int(i) + 5) for i in ids], "a long, b long").coalesce(1)
    for literals in ((0, 3), (-9, 1 << 20), (1 << 40, 2)):
        got = df.select(F.xxhash64("a", "b", *map(F.lit, literals)).alias("h"), F.pmod(F.xxhash64("a", "b", *map(F.lit, literals)), F.lit(7)).alias("m")).collect()
        want = skipgram._hashed(ids, ids + 5, *literals)
        assert [r.h for r in got] == want.tolist() and [r.m for r in got] == (want % 7).tolist()


@pytest.mark.parametrize("held", [1 << 21, 4])
def test_pairs_are_packed_without_vectors(spark, monkeypatch, held):
    """A round moves many pairs in a row and no vector beside a pair; rows hold every pair, and all of its part and block."""
    monkeypatch.setattr(skipgram, "_HELD_PAIRS", held)
    monkeypatch.setattr(skipgram, "PARAMETER_BYTES", 16 * 8 * 2 * 5)  # blocks of 5 words
    draw = random.Random(8)
    rows = [([draw.randrange(3000) if draw.random() < 0.5 else 1 for _ in range(40)],) for _ in range(50)]
    ids = spark.createDataFrame(rows, "ids array<int>").repartition(2)
    layout = skipgram._Layout(3000, 2, 2)
    pairs = skipgram._pairs(ids, 2, layout)
    found = Counter()
    for r in pairs.collect():
        words, near = np.frombuffer(r.a, np.int32), np.frombuffer(r.b, layout.local)
        assert set(words % layout.parts) == {r.part} and set((words & 1023).tolist()) == {r.place}
        for word, n, count in zip(words.tolist(), near.tolist(), np.frombuffer(r.c, f"u{r.width}").tolist(), strict=True):
            found[word, r.block * layout.each + n + 1] += count
    want = {(r.word, r.near): r.n for r in skipgram.pair_counts(ids, 2).collect()}
    assert dict(found) == want
    mass = {r.word: (r.total, r.kinds) for r in skipgram._mass(pairs).collect()}
    assert mass == {w: (sum(n for (a, _), n in want.items() if a == w), sum(a == w for a, _ in want)) for w in {a for a, _ in want}}


def test_one_round_equals_plain_sums(spark, monkeypatch):
    """One step from the first vectors: ``other`` starts at zero, so only it moves, by the mean of its neighbours' ``own``."""
    monkeypatch.setattr(skipgram, "PARAMETER_BYTES", 16 * 8 * 3 * 2)
    layout = skipgram._Layout(9, 3, 2)
    spark_state = skipgram._started(spark, layout, 5)
    own = {r.id: np.array(r.vec) for r in skipgram._own_vectors(spark_state, layout).collect()}
    first = spark.range(1, 10).select("id", *[(F.pmod(F.xxhash64(F.col("id"), F.lit(i), F.lit(5)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / 3.0 for i in (1, 2, 3)])
    assert {r[0]: list(r[1:]) for r in first.collect()} == {i: v.tolist() for i, v in own.items()}
    ids = spark.createDataFrame([([1, 9, 1, 4],), ([9, 9],)], "ids array<int>")
    pairs = skipgram._pairs(ids, 1, layout)
    moves = skipgram._gradients(pairs.unionByName(skipgram._sent(spark_state, layout)), layout)
    state = skipgram._moved(spark_state, moves, 0.5, layout).collect()
    other = {layout.first(r.block) + i: v for r in state for i, v in enumerate(np.frombuffer(r.b).reshape(-1, 3))}
    for near, by in {1: [9, 9, 4], 9: [1, 1, 9, 9], 4: [1]}.items():
        mean = np.mean([own[w] for w in by], axis=0) / 2
        assert np.allclose(other[near], 0.5 * mean / np.linalg.norm(mean))
    assert all(not other[i].any() for i in (2, 3, 5, 6, 7, 8)) and {r.id: list(r.vec) for r in skipgram._own_vectors(skipgram._moved(spark_state, moves, 0.5, layout), layout).collect()} == {i: v.tolist() for i, v in own.items()}
