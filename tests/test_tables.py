"""Joins, orders, samples, retrieval and corpus jobs."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import lookups
from pairloom.functions import vectors as V
from pairloom.operators import corpus, digests, joins, ordering, pairs, retrieval
from pairloom.plans import features


@pytest.fixture
def facts(spark):
    """One key holds a third of the rows."""
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, facts, how):
    dim = spark.createDataFrame([("hot", 1), ("k7", 2), ("k7", 3), ("none", 4)], "key string, v int")
    key = lambda df: sorted(map(str, map(tuple, df.select("id", *[c for c in df.columns if c != "id"]).collect())))
    plain = facts.join(dim, "key", how)
    assert key(joins.salted_join(facts, dim, ["key"], how, ["id"])) == key(plain)
    assert key(joins.lookup_join(facts, dim, "key", how, ["id"])) == key(plain)
    assert key(joins.lookup_join(facts, dim, "key", how, ["id"], max_bytes=0)) == key(plain)


def test_hot_key_is_spread(spark, facts):
    assert [r.key for r in joins.hot_keys(facts, ["key"], ["id"]).collect()][0] == "hot"
    dim = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.salted_join(facts, dim, ["key"], "inner", ["id"])
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_frame_bytes(spark):
    df = spark.createDataFrame([("abc", [1.0, 2.0], 5), (None, [], 6)], "s string, a array<double>, n long")
    small, large = joins.frame_bytes(df), joins.frame_bytes(df.union(df))
    assert 0 < small and large == 2 * small


def test_excluding(spark, facts):
    seen = spark.createDataFrame([("hot",), ("hot",), ("k1",)], "key string")
    left = pairs.excluding(facts, seen, "key", ["id"])
    assert left.count() == facts.where("key not in ('hot', 'k1')").count()


def test_positions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("x"))
    rows = ordering.with_position(df, [F.desc("x")]).collect()
    assert {r.position: r.x for r in rows} == {1000 - x: x for x in range(1000)}
    by_group = ordering.with_position(df, [F.asc("x")], within="g").collect()
    for g in range(3):
        xs = [r.x for r in sorted((r for r in by_group if r.g == g), key=lambda r: r.position)]
        assert xs == sorted(xs) and [r.position for r in by_group if r.g == g and r.x == xs[0]] == [1]


def test_sample_and_shuffle(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    order = sorted(range(200), key=lambda k: hashlib.md5(f"{k}:5".encode()).hexdigest())
    assert [r.k for r in ordering.shuffled(df, "k", 5).collect()] == order
    assert {r.k for r in ordering.sample_rows(df, "k", n=30, seed=5).collect()} == set(order[:30])
    assert {r.k for r in ordering.sample_rows(df, "k", fraction=0.1, seed=5).collect()} == set(order[:20])
    assert ordering.sample_rows(df, "k", n=500, seed=5).count() == 200
    with pytest.raises(ValueError):
        ordering.sample_rows(df, "k")


@pytest.mark.parametrize("digits", [1, 4])
def test_sample_limit_by_digits(spark, monkeypatch, digits):
    monkeypatch.setattr(ordering, "_DIGITS", digits)
    rows = [*range(300), *[7] * 40, *[9] * 40]  # repeated keys share their place in the order
    df = spark.createDataFrame([(k, n) for n, k in enumerate(rows)], "k long, n long")
    order = sorted(rows, key=lambda k: hashlib.md5(f"{k}:1".encode()).hexdigest())
    for n in (0, 1, 77, 150, 200, 260, 300, 379, 380):
        got = ordering.sample_rows(df, "k", n=n, seed=1)
        assert sorted(r.k for r in got.collect()) == sorted(order[:n])
    plan = ordering.sample_rows(df, "k", n=77, seed=1)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[1]


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 8))
    data[17] = data[3]
    data[40] = 0
    return data, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "item long, vec array<double>").repartition(5)


def unit(m):
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n == 0, 1, n)


@pytest.mark.parametrize(("block", "limit"), [(1024, None), (2, None), (3, 0), (3, 150)])
def test_retrieval_equals_brute_force(spark, vectors, monkeypatch, block, limit):
    monkeypatch.setattr(retrieval, "_QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "_ITEM_BLOCK", 16 * block)
    monkeypatch.setattr(retrieval, "CELL_BYTES", 4096)
    data, corpus_vecs = vectors
    queries = corpus_vecs.where("item in (3, 5, 40, 99, 120)").select(F.col("item").alias("query"), "vec")
    scores = np.round(unit(data) @ unit(data).T, 12)
    got = {(r.query, r["rank"]): r["item"] for r in retrieval.retrieve(queries, corpus_vecs, 7, limit).collect()}
    full = {(r.query, r["rank"]): r["item"] for r in retrieval.ranked(retrieval.cosine_scores(queries, corpus_vecs, limit)).collect()}
    monkeypatch.setattr(retrieval, "_ASKED_ITEMS", 30)
    asked = queries.select("query").join(corpus_vecs.select("item").where("item % 3 = 0 or item = 17"))
    ranks = {(r.query, r["item"]): r["rank"] for r in retrieval.ranks_of(asked, queries, corpus_vecs, limit).collect()}
    assert ranks == {(q, i): k for (q, k), i in full.items() if i % 3 == 0 or i == 17}
    for q in (3, 5, 40, 99, 120):
        order = sorted(range(200), key=lambda i: (-scores[q, i], i))
        assert [got[q, k] for k in range(7)] == order[:7]
        assert [full[q, k] for k in range(200)] == order
    assert got[3, 0] == 3 and got[3, 1] == 17


def test_empty_queries(spark, vectors):
    none = vectors[1].where("item < 0").select(F.col("item").alias("query"), "vec")
    assert retrieval.retrieve(none, vectors[1]).count() == 0
    assert retrieval.cosine_scores(none, vectors[1]).count() == 0
    assert retrieval.ranks_of(none.select("query", F.lit(1).alias("item")), none, vectors[1]).count() == 0


def test_text_items(spark):
    items = spark.createDataFrame([(f"i{n}", [1.0, n / 9]) for n in range(30)] + [("a", [1.0, 0.0])], "item string, vec array<double>").repartition(4)
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query string, vec array<double>")
    assert [r["item"] for r in retrieval.retrieve(queries, items, 3).orderBy("rank").collect()] == ["a", "i0", "i1"]
    asked = spark.createDataFrame([("q", "i0"), ("q", "i29"), ("q", "none"), ("p", "a"), ("q", "i0")], "query string, item string")
    assert {r["item"]: r["rank"] for r in retrieval.ranks_of(asked, queries, items).collect()} == {"i0": 1, "i29": 30}


def test_mean_cosines(spark, vectors):
    data, df = vectors
    pairs_df = df.select("item", F.col("vec").alias("a"), F.reverse("vec").alias("b"))
    sims = unit(data) @ unit(data[:, ::-1]).T
    off = sims[~np.eye(200, dtype=bool)].mean()
    assert retrieval.mean_paired_cosine(pairs_df).first()[0] == pytest.approx(np.diag(sims).mean())
    assert retrieval.mean_unpaired_cosine(pairs_df).first()[0] == pytest.approx(off)
    assert retrieval.mean_unpaired_cosine(pairs_df.where("item = 1")).first()[0] is None


def test_vector_lookup(spark):
    vecs = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", 3, [3.0])], "key string, o int, vec array<double>")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, "zz")], "id int, key string")
    got = {r.id: r.vec for r in retrieval.with_vectors(rows, vecs, "key", "o", ["id"]).collect()}
    assert got == {1: [2.0], 2: [3.0]}
    assert retrieval.lookup_misses(rows, vecs, "key").first()[0] == 2
    both = retrieval.blended(vecs.where("o > 1"), vecs.where("o > 1").withColumn("vec", F.array(F.lit(0.0))), 0.5)
    assert {r.key: r.vec for r in both.collect()} == {"a": [1.0], "b": [1.5]}
    named = retrieval.all_splits(train=rows, test=rows).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in named} == {"train": 4, "test": 4}


def test_tanimoto(one):
    assert one(V.tanimoto_bits("a", "b"), schema="a array<long>, b array<long>", a=[0b1100, -1], b=[0b0110, -1]) == pytest.approx(65 / 67)
    assert one(V.tanimoto_sets("a", "b"), schema="a array<string>, b array<string>", a=["x", "y"], b=["y"]) == 0.5
    assert one(V.tanimoto_sets("a", "b"), schema="a array<string>, b array<string>", a=[], b=[]) == 0.0
    got = one(V.tanimoto_counts("a", "b"), schema="a map<string,int>, b map<string,int>", a={"x": 3, "y": 1}, b={"x": 2, "z": 4})
    assert got == pytest.approx(2 / (4 + 6 - 2))
    assert one(V.cosine("a", "b"), schema="a array<double>, b array<double>", a=[0.0], b=[1.0]) == 0.0


@pytest.fixture
def sentences(spark):
    rows = [(0, "a a b c a".split()), (1, "a b b x".split()), (2, []), (3, "y a c a y z".split())]
    return spark.createDataFrame(rows, "sent_id long, words array<string>"), dict(rows)


@pytest.mark.parametrize("threshold", [1, 2, 3, 100])
def test_unknown_words(sentences, threshold):
    df, rows = sentences
    counts = Counter(w for ws in rows.values() for w in ws)
    got = {r.sent_id: r.words for r in corpus.with_unknown(df, threshold).collect()}
    assert got == {i: [w if counts[w] > threshold else "UNK" for w in ws] for i, ws in rows.items()}
    assert {r.word for r in corpus.rare_words(df, threshold).collect()} == {w for w, n in counts.items() if n <= threshold}


@pytest.mark.parametrize(("limit", "held"), [(joins.BROADCAST_BYTES, corpus.TABLE_BYTES), (joins.BROADCAST_BYTES, 100), (0, 1)])
def test_sentence_vectors(spark, sentences, monkeypatch, limit, held):
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", None, limit))
    monkeypatch.setattr(lookups, "_CHUNK_VALUES", 4)  # a text's words are added in several steps
    df, rows = sentences
    table = {"a": [1.0, 0.5], "b": [0.0, 2.0], "UNK": [10.0, 10.0]}
    vecs = spark.createDataFrame(list(table.items()), "word string, vec array<double>")
    for unseen in (None, "UNK"):
        got = {r.sent_id: r.vec for r in corpus.sentence_vectors(df, vecs, unseen, max_bytes=held).collect()}
        for i, ws in rows.items():
            found = [table.get(w, table["UNK"] if unseen else None) for w in ws]
            found = [v for v in found if v is not None]
            assert got[i] == (np.sum(found, axis=0).tolist() if found else [])
    with pytest.raises(KeyError):
        corpus.sentence_vectors(df, vecs, "nope")


def test_vector_plan_has_no_token_rows(spark, sentences):
    vecs = spark.createDataFrame([("a", [1.0])], "word string, vec array<double>")
    plan = corpus.sentence_vectors(sentences[0], vecs)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("held", [corpus.TABLE_BYTES, 60, 1])
def test_token_ids(spark, sentences, held):
    df, rows = sentences
    ids = corpus.word_ids(corpus.word_counts(df))
    table = {r.word: r.id for r in ids.collect()}
    counts = Counter(w for ws in rows.values() for w in ws)
    assert sorted(table, key=table.get) == sorted(counts, key=lambda w: (-counts[w], w)) and min(table.values()) == 1
    got = {r.sent_id: r.ids for r in corpus.token_ids(df, ids.where("word <> 'a'"), F.col("words"), 4, row_id="sent_id", max_bytes=held).collect()}
    assert got == {i: [0 if w == "a" else table[w] for w in ws[:4]] for i, ws in rows.items()}


def test_null_words_and_texts(spark):
    df = spark.createDataFrame([(1, ["a", None, "a"]), (2, None), (3, [])], "sent_id long, words array<string>")
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("U", [5.0, 5.0])], "word string, vec array<double>")
    assert {r.sent_id: r.vec for r in corpus.sentence_vectors(df, vecs).collect()} == {1: [2.0, 4.0], 2: [], 3: []}
    assert {r.sent_id: r.vec for r in corpus.sentence_vectors(df, vecs, "U").collect()} == {1: [7.0, 9.0], 2: [], 3: []}
    table = spark.createDataFrame([("a", 4)], "word string, id int")
    assert {r.sent_id: r.ids for r in corpus.token_ids(df, table, F.col("words"), row_id="sent_id").collect()} == {1: [4, 0, 4], 2: [], 3: []}


def test_digests(spark):
    rows = [(5, "a", None), (3, "a", ""), (4, "a", None), (1, "ab", "c"), (2, "a", "bc"), (6, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "i long, x string, y string")
    assert {r.i for r in digests.distinct_rows(df, ["x", "y"], "i").collect()} == {3, 4, 1, 2, 6}
    seen = spark.createDataFrame([("a",), (None,), ("",)], "x string")
    assert {r.i for r in digests.without_texts(df, seen, "x", ["i"]).collect()} == {1, 6, 7}


def test_tokenised_pairs(spark):
    ranked = spark.createDataFrame([(1, "a b zz", "b"), (2, "", "a a")], "pair_id long, chosen string, rejected string")
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2)], "word string, id int")
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    bare = {r.pair_id: tuple(r)[1:] for r in corpus.tokenised_pairs(ranked, vocabulary, split).collect()}
    assert bare == {1: ([1, 2, 0], [1, 1, 1], [2], [1]), 2: ([], [], [1, 1], [1, 1])}
    full = {r.pair_id: tuple(r)[1:] for r in corpus.tokenised_pairs(ranked, vocabulary, split, 2, 9).collect()}
    assert full == {1: ([1, 2], [1, 1], [2, 9], [1, 0]), 2: ([9, 9], [0, 0], [1, 1], [1, 1])}


def test_corpus_modes_and_features(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, None), (2, " ")], "sent_id long, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    kinds = {(r.sent_id, r.kind): r.words for r in corpus.corpus_sentences(df, tokens, 1, "all").collect()}
    assert kinds == {(0, "r0"): ["a", "b", "c"], (0, "r1"): ["a_b", "b_c"], (0, "alt"): ["a", "a_b", "b", "b_c", "c"]}
    with pytest.raises(ValueError):
        corpus.corpus_sentences(df, tokens, 1, "other")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b_c", [0.0, 2.0])], "word string, vec array<double>")
    out = features.featurize(df, tokens, vecs)
    assert [(r.sent_id, r.vec) for r in out.collect()] == [(0, [1.0, 2.0])]
    assert features.feature_columns(out, 2).columns == ["sent_id", "text", "mol2vec-000", "mol2vec-001"]


def test_train_vectors(spark):
    df = spark.createDataFrame([(i, "a b c d " * 5 + f"w{i}") for i in range(8)], "sent_id long, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    vecs = features.train_vectors(df, tokens, vector_size=4, window=2, seed=1)
    words = {r.word: len(r.vec) for r in vecs.collect()}
    assert set(words) >= {"a", "a_b", "UNK"} and set(words.values()) == {4} and "w1" not in words


def test_nested_columns_are_measured(spark):
    df = spark.range(100).select(
        F.map_from_arrays(F.array(F.lit("key")), F.array(F.repeat(F.lit("v"), 10_000))).alias("m"),
        F.struct(F.repeat(F.lit("s"), 10_000).alias("t")).alias("s"), F.array(F.array(F.repeat(F.lit("a"), 10_000))).alias("a"))
    assert joins.frame_bytes(df) >= 3_000_000


def test_vectors_of_mixed_width_raise(spark):
    sentences = spark.createDataFrame([(1, ["a", "b"])], "sent_id bigint, words array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "word string, vec array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        corpus.sentence_vectors(sentences, vectors)
