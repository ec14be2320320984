"""Ranked lexical search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from pairloom.llm import lexical

TERM = "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(TERM, text or "")]


def brute(docs, items, k):
    found = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs, n_terms = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in found:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(n * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(draw, size):
    words = [f"w{i}" for i in range(200)] + ["The", "the", "Ünï", "ünï", "中文", "x1", "a"]
    share = [1 / (i + 1) for i in range(len(words))]
    texts = [draw.choices([" ", ", ", "-"], k=1)[0].join(draw.choices(words, share, k=draw.choice([1, 5, 40, 300]))) for _ in range(size)]
    return [(i, t) for i, t in enumerate(texts)]


def frames(spark, docs, items):
    columns = "doc_id bigint, text string, item bigint, doc int, score string, rank int, `a.b` int"
    return (spark.createDataFrame([(*d, 1, 2, "s", 3, 4) for d in docs], columns).repartition(3),
            spark.createDataFrame([(*i, 1, "t") for i in items], "item_id bigint, text string, doc_id bigint, score string"))


@pytest.mark.parametrize(("bucket", "held", "share"), [(512, 1 << 22, 0.95), (7, 500, 0.5), (1, 1 << 22, 0.99)])
def test_ranking_equals_all_scores(spark, monkeypatch, bucket, held, share):
    monkeypatch.setattr(lexical, "_BUCKET", bucket)
    monkeypatch.setattr(lexical, "_HELD_ENTRIES", held)
    monkeypatch.setattr(lexical, "_LEADING_SHARE", share)
    draw = random.Random(bucket)
    docs = corpus(draw, 300)
    docs += [docs[3], docs[3], (900, docs[5][1]), (800, docs[5][1]), (None, docs[5][1]), (None, docs[6][1]), (901, None), (902, ""), (903, "?!"), (904, "the " * 50_000)]
    items = [(i, " ".join(draw.choices(docs[draw.randrange(300)][1].split() or ["w1"], k=draw.choice([1, 4, 30])))) for i in range(25)]
    items += [items[0], (1, "w3 w3 unseen"), (None, "w7 中文"), (70, None), (71, ""), (72, "..."), (73, "unseen"), (74, "the"), (75, docs[5][1])]
    got = lexical.ranked_search(*frames(spark, docs, items), k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_rounds_and_empty_tables(spark, monkeypatch):
    docs, items = corpus(random.Random(1), 60), [(i, f"w{i} the w{i + 1}") for i in range(12)]
    monkeypatch.setattr(lexical, "ROUND_BYTES", 40)
    d, i = frames(spark, docs, items)
    assert sorted(map(tuple, lexical.ranked_search(d, i, k=3).collect()), key=str) == brute(docs, items, 3)
    assert lexical.ranked_search(d.limit(0), i).count() == 0 and lexical.ranked_search(d, i.limit(0)).count() == 0
    assert lexical.ranked_search(d, i.withColumn("text", i.score)).count() == brute(docs, [(x, "t") for x, _ in items], 10).__len__()


def test_bounds_never_lose_a_document():
    """Survivors at any threshold hold every document that reaches it."""
    import numpy as np
    import pyarrow as pa
    draw = np.random.default_rng(2)
    weights = draw.integers(0, 9000, 60)
    for _ in range(40):
        sizes = draw.integers(1, 20, 30)
        terms = np.concatenate([draw.choice(60, s, replace=False) for s in sizes])
        times = draw.integers(1, 9, len(terms))
        m = draw.integers(25, 400, 30)
        impacts = lexical.impacts_of(weights, terms, times, np.repeat(m, sizes)).astype(float)
        lengths = np.sqrt(np.add.reduceat(impacts ** 2, np.cumsum(sizes) - sizes))
        bucket = lexical.Bucket({"docs": pa.array(range(30)), "lengths": pa.array(lengths), "sizes": pa.array(sizes), "terms": pa.array(terms), "times": pa.array(times), "m": pa.array(m)}, weights)
        asked_terms, counts = draw.choice(60, 12, replace=False), draw.integers(1, 4, 12)
        asked = np.zeros(60, np.int64)
        asked[asked_terms] = counts
        scores = bucket.scores(np.arange(30), asked)
        for threshold in [0, *np.unique(scores).tolist()]:
            kept = set(bucket.survivors(asked_terms, counts, threshold).tolist())
            assert {i for i, s in enumerate(scores.tolist()) if s >= threshold and s > 0} <= kept
