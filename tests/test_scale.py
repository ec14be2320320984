"""Bounds of memory and moved bytes: batches are cut into slices, tables on the driver stay small."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.functions import kernels, lookups
from pairloom.functions import text as X
from pairloom.operators import corpus, pairs, skipgram
from pairloom.plans import features
from pairloom.sources import readers, writers


@pytest.mark.parametrize("counts", [[50, 9, 9, 9, 3, 3, 1], [4], [1, 1, 1], []])
def test_noise_runs_equal_slots(spark, counts):
    vocabulary = spark.createDataFrame([(i + 1, n) for i, n in enumerate(counts)], "id long, n long")
    runs, slots = skipgram._noise(vocabulary)
    mass = np.array(counts, float) ** skipgram.NOISE_POWER
    each = np.maximum(1, np.round(mass / max(mass.sum(), 1) * len(counts) * skipgram._SLOTS_PER_WORD)).astype(int)
    assert slots == each.sum() and runs.shape == (3, len(set(each)))
    held = spark.sparkContext.broadcast(runs)
    got = spark.range(slots).select("id", skipgram._word_at(F.col("id"), held).alias("near")).orderBy("id").collect()
    assert [r.near for r in got] == np.repeat(np.arange(len(counts)) + 1, each).tolist()


def test_parameters_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(n, [f"w{draw.randrange(9)}" for _ in range(8)]) for n in range(40)]
    df = spark.createDataFrame(rows, "sent_id long, words array<string>")
    trained = lambda: {r.word: r.vec for r in skipgram.train_skipgram(df, 4, 2, rounds=1, seed=1).collect()}
    small = trained()
    monkeypatch.setattr(skipgram, "PARAMETER_BYTES", 0)
    large = trained()
    assert small.keys() == large.keys() and all(np.allclose(small[w], large[w], atol=1e-9) for w in small)


@pytest.mark.parametrize("bound", [1 << 16, 3])
def test_kernels_cut_batches(spark, monkeypatch, bound):
    """The bound on a slice holds in every kernel, and slices change no result."""
    sizes = []
    slices = kernels._slices

    def noted(lengths):
        for lo, hi in slices(lengths):
            sizes.append((hi - lo, int(lengths[lo:hi].sum())))
            yield lo, hi

    monkeypatch.setattr(kernels, "_TOKENS_PER_SLICE", bound)
    monkeypatch.setattr(lookups, "_slices", noted)
    lists = pa.array([["a", "b", "c"], [], None, ["b", "x"], ["a"], ["c", "c"]], pa.list_(pa.string()))
    got = lookups._by_slices(lists, lambda part: pa.array([None if x is None else len(x) for x in part.to_pylist()], pa.int64()))
    assert got.to_pylist() == [3, 0, None, 2, 1, 2] and all(rows == 1 or tokens <= bound for rows, tokens in sizes) and len(sizes) == (1 if bound > 3 else 3)
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None), (4, ["b", "x"]), (5, ["c", "c"])], "sent_id long, words array<string>").coalesce(1)
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, id int")
    ids = corpus.token_ids(df, vocabulary, F.col("words"), row_id="sent_id")
    assert {r.sent_id: r.ids for r in ids.collect()} == {1: [1, 2, 3], 2: [], 3: [], 4: [2, 0], 5: [3, 3]}
    assert {(r.word, r.near): r.n for r in skipgram.pair_counts(ids, 1).collect()} == {(1, 2): 1, (2, 1): 1, (2, 3): 1, (3, 2): 1, (3, 3): 2}
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [10.0]), ("c", [100.0])], "word string, vec array<double>")
    assert {r.sent_id: r.vec for r in corpus.sentence_vectors(df, vectors).collect()} == {1: [111.0], 2: [], 3: [], 4: [10.0], 5: [200.0]}


def test_one_sort_equals_many():
    draw = np.random.default_rng(1)
    for rows, kinds in ((1, 2), (5, 3), (40, 60)):
        sizes = draw.integers(0, 9, 2 * rows)
        word = draw.integers(0, kinds, sizes.sum()) * 9973
        one = kernels._clip_sorted(word, sizes, rows, 4) if len(word) else None
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(kernels, "_clip_sorted", lambda *_: None)
            assert one is None or one.tolist() == kernels._clip_numbers(word, sizes, rows, 4).tolist()
    assert kernels._clip_sorted(np.arange(1 << 17), np.array([1 << 16, 1 << 16]), 1, 4) is None


def test_alternating_sentences(spark):
    rows = [["a", "b", "c"], ["a"], [], None, ["a", None, "b", "c"], [None]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>").coalesce(1)
    for radius in (0, 1, 2):
        got = {r.i: r.s for r in df.select("i", kernels.alternated("t", radius, "_").alias("s")).collect()}
        grams = lambda r: ["_".join(r[i:i + n]) for i in range(len(r)) for n in range(1, radius + 2) if i + n <= len(r) and None not in r[i:i + n]]
        assert got == {i: None if r is None else grams(r) for i, r in enumerate(rows)}


def test_known_counts_spare_a_pass(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "!"), (4, "c")], "sent_id long, text string")
    words = X.alnum_words("text")
    sentences = corpus.corpus_sentences(df, words, 1, "alt")
    assert {r.sent_id: r.words for r in sentences.collect()} == {1: ["a", "a_b", "b", "b_a", "a"], 4: ["c"]}
    vectors = spark.createDataFrame([("a", [1.0]), ("a_b", [10.0]), ("c", [100.0])], "word string, vec array<double>")
    counts = corpus.word_counts(sentences).localCheckpoint()
    want = {r.sent_id: r.vec for r in features.featurize(df, words, vectors).collect()}
    monkeypatch.setattr(corpus, "word_counts", None)
    part = corpus.sentence_vectors(sentences, vectors, max_bytes=200, counts=counts)
    assert {r.sent_id: r.vec for r in part.collect()} == want == {1: [12.0], 4: [100.0]}


def test_callers_batches_are_bounded(spark):
    def predict(batch):
        return batch[["pair_id"]].assign(output=batch["prompt"] + str(len(batch)))

    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)] + [(50, None)], "pair_id long, prompt string").coalesce(1)
    got = pairs.score_batches(df, predict, "pair_id bigint, output string", max_bytes=5000).collect()
    assert [r.pair_id for r in got] == list(range(51)) and got[50].output is None
    assert all(int(r.output[1000:]) <= 6 for r in got[:50])
    dated = df.withColumn("at", F.current_timestamp())
    assert pairs.score_batches(dated, predict, "pair_id bigint, output string").count() == 51


def test_one_prediction_for_both_directions(spark):
    texts = spark.createDataFrame([(1, "m", "c"), (1, "n", "d"), (2, "o", "e"), (None, "p", "f")], "pair_id long, molecule string, caption string")
    predicted = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "z")], "pair_id long, predicted string")
    each = predicted.withColumn("direction", F.explode(F.array(*map(F.lit, pairs.DIRECTIONS))))
    rows = lambda p: sorted(map(str, pairs.triples_by_direction(texts, p).collect()))
    assert rows(predicted) == rows(each) and len(rows(each)) == 10


def test_compressed_csv_reads_back(spark, tmp_path):
    rows = [("a,\"b\"", "two\nlines", ""), (" é ", "\t", "x" * 5000)]
    path = str(tmp_path / "triples")
    writers.write_csv(spark.createDataFrame(rows, "source string, chosen string, rejected string"), path, compression="gzip")
    assert all(f.name.endswith(".csv.gz") for f in (tmp_path / "triples").glob("part-*"))
    assert sorted(map(tuple, readers.read_triples(spark, path).select("source", "chosen", "rejected").collect())) == sorted(rows)


def test_trainer_reads_sentences_twice_and_splits_none(spark):
    """One pass counts the words, one deals the sentences out; the vectors are Spark ML's for sentences left whole."""
    draw, read = random.Random(3), spark.sparkContext.accumulator(0)
    lengths = [2500, *range(1, 40)]
    texts = [" ".join(draw.choices("abcdefgh", range(8, 0, -1), k=n)) for n in lengths]

    @F.udf("array<string>")
    def words(text):
        read.add(1)
        return text.split()

    sentences = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(words("text").alias("words"))
    fitted = lambda n: {r.word: r.vec for r in corpus.word_vectors(corpus.fit_word_vectors(sentences, 4, 2, 3, 5, 1, max_length=n)).collect()}
    whole = fitted(None)
    assert read.value == 2 * len(texts) and set(whole) == set("abcdefgh")
    assert whole == fitted(max(lengths)) != fitted(10)


def test_trainer_takes_null_sentences(spark):
    sentences = spark.createDataFrame([(["a", "b", "a"] * 3,), (None,), ([],), (["c", "b"],)], "words array<string>")
    vectors = corpus.word_vectors(corpus.fit_word_vectors(sentences, 4, 2, 3, 5))
    assert {r.word: len(r.vec) for r in vectors.collect()} == {"a": 4, "b": 4}


def test_word_filter_misses_no_word(spark):
    words = ["", "a", "ab", "é" * 9, "x" * 8, "x" * 9, "x" * 100, *(f"w{i}" for i in range(500))]
    held = lookups.word_filter(spark.createDataFrame([(w,) for w in [*words, None]], "word string").repartition(3), len(words)).value
    assert lookups._may_hold(held, pa.array(["?", *words])[1:]).all()
    others = pa.array([f"{w}_{i}" for i, w in enumerate(words)] * 4)
    assert lookups._may_hold(held, others).mean() < 0.05 and len(set(lookups._word_hashes(pa.array(words)).tolist())) == len(words)


@pytest.mark.parametrize("words_held", [1 << 21, 3])
@pytest.mark.parametrize("unseen", [None, "UNK"])
def test_sums_of_a_large_table_go_by_groups(spark, monkeypatch, words_held, unseen):
    """Sentences with one id, or none, keep their own sums; a word is joined once for a group, however many sentences have it."""
    monkeypatch.setattr(lookups, "_GROUP_WORDS", words_held)
    monkeypatch.setattr(lookups, "_GROUP_BYTES", 5 * 8 * 2)
    draw = random.Random(6)
    rows = [(draw.choice([None, "s1", f"s{n}"]), draw.choices([*(f"w{i}" for i in range(12)), "no", None], k=draw.randrange(9))) for n in range(60)] + [("s1", None), ("z", [])]
    df = spark.createDataFrame(rows, "sent_id string, words array<string>").repartition(2)
    table = [(f"w{i}", [float(i), 0.1 * i]) for i in range(12)] + [("UNK", [1000.0, 0.5])]
    vectors = spark.createDataFrame(table, "word string, vec array<double>")
    shown = lambda out: sorted((str(r.sent_id), [round(x, 6) for x in r.vec]) for r in out.collect())
    small = corpus.sentence_vectors(df, vectors, unseen)
    large = corpus.sentence_vectors(df, vectors, unseen, max_bytes=250)
    assert shown(large) == shown(small) and len(shown(large)) == len(rows)
    tail = vectors.where("word > 'w3'")
    head, known = lookups.shared_vectors(vectors.where("word = 'w1'"), 2), lookups.word_filter(tail, 9)
    parts = lookups.grouped_sums(df, "sent_id", head, known, 2).collect()
    joined = [(r._group, r.word) for r in parts if r._at is None]
    assert len(joined) == len(set(joined)) and {w for _, w in joined} >= {"w4", "w9"}
    if words_held > 3:
        assert all(sum(r._group == g and r._at is not None for r in parts) <= 5 for g in {r._group for r in parts})


def test_vectors_travel_as_floats_where_exact(spark):
    rows = [("a", [0.5, -2.0]), ("b", [0.1, 1.0]), ("c", [float(np.float32(0.1)), 3.0])]
    packed = {r.word: len(r.data) for r in lookups.packed_vectors(spark.createDataFrame(rows, "word string, vec array<double>")).collect()}
    assert packed == {"a": 8, "b": 16, "c": 8}
    assert lookups._unpacked(pa.array([np.array([0.1, 1.0]).tobytes(), None, np.array([0.5, -2.0], np.float32).tobytes()], pa.binary()), 2).tolist() == [[0.1, 1.0], [0, 0], [0.5, -2.0]]
    table = lambda keep: spark.createDataFrame([r for r in rows if r[0] in keep], "word string, vec array<double>")
    assert lookups.shared_table(table("ac"), "vec").value[1].dtype == np.float32 and lookups.shared_table(table("ab"), "vec").value[1].dtype == np.float64


def test_frequent_words_fit_the_room(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 9), ("c", 4), ("d", 4), ("e", 1), (None, 99)], "word string, n long")
    vectors = spark.createDataFrame([(w, [1.0]) for w in "abcdx"], "word string, vec array<double>")
    chosen = lambda room: {r.word for r in corpus._frequent(vectors, counts, room).collect()}
    assert [chosen(n) for n in (1, 2, 3, 4, 9)] == [{"a"}, {"a", "b"}, {"a", "b"}, set("abcd"), set("abcd")]


def test_records_are_taken_apart_once(spark, monkeypatch):
    from pairloom.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.features, "featurize", lambda rows, *a, f=features.featurize, **b: seen.append(rows) or f(rows, *a, **b))
    catalog.feature_file(spark, "/root/testdata/sf0.001")
    assert seen and all(f.endswith(".parquet") for f in seen[0].inputFiles())
