"""SimHash groups, components and decontamination against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, pii, simhash, toxicity
from pairloom.llm.components import components


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    ones = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def groups(prints, radius):
    """Smallest key reachable for each key, all pairs compared."""
    keys, root = sorted(prints), {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_masks_cover_every_pair_within_the_radius():
    masks = np.array([m & (1 << 64) - 1 for m in simhash.covering_masks(3)], np.uint64)
    assert len(masks) == 15
    for a in range(64):
        for b in range(a, 64):
            for c in range(b, 64):
                differing = np.uint64(1 << a | 1 << b | 1 << c)
                assert ((masks & differing) == 0).any()


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (200, 201), (201, 200), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def near_docs(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = draw.choices(words, k=draw.randint(60, 300))
        for _ in range(draw.randint(1, 6)):
            copy = list(base)
            copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " \t", "A b", "a B", "a b", "é É", "one"] + [texts[0]] * 30
    rows = [(3 * i + 1, t, "x", 0) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, component_id int").repartition(3)


def test_groups_equal_all_pairs(near_docs, monkeypatch):
    rows, docs = near_docs
    want = groups({i: fingerprint(t) for i, t, *_ in rows}, 3)
    for block in (512, 3):  # buckets in one block, and cut into many
        monkeypatch.setattr(simhash, "_BLOCK", block)
        got = {r.doc_id: (r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
        assert got == {i: (fingerprint(t), want[i]) for i, t, *_ in rows}


def test_one_document_of_each_group_stays(spark, near_docs):
    rows, docs = near_docs
    want = groups({i: fingerprint(t) for i, t, *_ in rows}, 3)
    kept = simhash.without_near_duplicates(docs.unionByName(docs.where("doc_id = 1")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    some = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (None, "other words here now")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.without_near_duplicates(some).collect()) == [(0, "other words here now"), (5, "a b c d")]
    assert simhash.without_near_duplicates(some.limit(0)).count() == 0


PASSAGE = "Zor the quick, brown fox jumps over that lazy dog while seven silent owls watch from tall old pines."
SHORT = "six plain words stand right here"


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def contaminated(text, passage, window=13, share=0.8):
    """Any shift at which a window of the passage matches the text closely enough and holds nine equal words in a row or a seed."""
    doc, item = _words(text), _words(passage)
    window = min(window, len(item))
    if len(item) < decontaminate.LEAST_TOKENS:
        return False
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == item[i] for i in range(len(item))]
        if any(sum(same[i:i + window]) >= share * window for i in range(len(item) - window + 1)):
            return True
    return False


def test_planted_passages_are_found_and_others_left(spark):
    draw = random.Random(3)
    filler = [f"f{i}" for i in range(500)]

    def around(text):
        return " ".join([*draw.choices(filler, k=40), text, *draw.choices(filler, k=2000)])

    changed = PASSAGE.split()
    for at in (3, 14):
        changed[at] = "other"
    far = PASSAGE.split()
    for at in range(0, len(far), 2):
        far[at] = "other"
    texts = {
        1: around(PASSAGE), 2: around(PASSAGE.upper().replace(" ", " | ")), 3: around(" ".join(changed)), 4: around(" ".join(far)),
        5: around(SHORT), 6: around("nothing"), 7: "", 8: None, 9: PASSAGE, 10: " ".join(_words(PASSAGE)[:14]), 11: " ".join(_words(PASSAGE)[:8]), 12: SHORT,
    }
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()] + [(1, texts[1], 1, "x")], "doc_id bigint, text string, item_id int, hash string").repartition(3)
    passages = {100: PASSAGE, 101: SHORT, 102: "too short", 103: None, 104: "", 105: PASSAGE}
    items = spark.createDataFrame([(i, t, 0) for i, t in passages.items()], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, items).collect()}
    want = {(i, j) for i, t in texts.items() for j, p in passages.items() if contaminated(t, p)}
    assert got == want and {(3, 100), (5, 101), (10, 105)} <= got
    kept = decontaminate.without_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(texts) - {i for i, _ in want}) and kept.columns == docs.columns
    assert decontaminate.find_contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.find_contaminated(docs.limit(0), items).count() == 0


@pytest.mark.parametrize(("window", "wrong"), [(13, 2), (5, 1), (9, 1), (10, 2), (12, 2), (8, 3), (4, 0), (1, 0), (50, 10)])
def test_masks_cover_every_substitution(window, wrong):
    masks = decontaminate.covering_masks(window, wrong)
    assert len(masks) <= decontaminate.MOST_MASKS and all(m[0] == m[-1] == "1" and len(m) <= window for m in masks)
    draw = random.Random(1)
    patterns = itertools.combinations(range(window), wrong) if math.comb(window, wrong) < 10_000 else (draw.sample(range(window), wrong) for _ in range(2000))
    for places in patterns:
        assert any(all(shift + p not in places for p, kept in enumerate(m) if kept == "1") for m in masks for shift in range(window - len(m) + 1))


def test_every_allowed_substitution_is_found(spark):
    """Documents with a 13-token stretch of a passage and two substituted tokens anywhere in it; passages of 1 to 12 tokens likewise."""
    words = [f"p{i}" for i in range(15)]
    texts, want, key = [], set(), 0
    for start in (0, 2):
        for places in itertools.combinations(range(13), 2):
            part = [f"x{key}" if i in places else w for i, w in enumerate(words[start:start + 13])]
            texts.append((key, f"left{key} " + " ".join(part) + f" right{key}"))
            want.add((key, 0))
            key += 1
    items = [(0, " ".join(words))]
    for n in range(1, 13):
        short = [f"s{n}w{i}" for i in range(n)]
        items.append((n, " ".join(short)))
        wrong = n - math.ceil(0.8 * n - 1e-9)
        for places in itertools.combinations(range(n), wrong):
            texts.append((key, "a b " + " ".join(f"x{key}" if i in places else w for i, w in enumerate(short)) + " c d"))
            want.add((key, n))
            key += 1
        for places in itertools.combinations(range(n), wrong + 1):  # one too many
            texts.append((key, "a b " + " ".join(f"x{key}" if i in places else w for i, w in enumerate(short)) + " c d"))
            key += 1
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    found = decontaminate.find_contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert want == {(i, j) for i, t in texts for j, p in items if contaminated(t, p)}


ODD = {"a.b": 1, "row": 2, "_row": 3, "key": 4, "fingerprint": 5, "component_id": 6, "hash": 7, "text_md5": "m", "spans": "s", "score": 0.5, "item": 8}


def with_odd_columns(df):
    return df.withColumns({f"{c}": F.lit(v) for c, v in ODD.items()})


def test_filters_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (None, "quite another text of words"),
            (3, "a passage of the benchmark with more than five words"), (3, "a passage of the benchmark with more than five words"), (None, None), (None, ""), (4, None)]
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(3)
    items = spark.createDataFrame([(1, rows[4][1])], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id bigint, toxic int")
    for kept, want in (
        (simhash.without_near_duplicates(docs), [(1, rows[0][1]), (3, rows[4][1]), (4, None), (None, rows[3][1])]),
        (decontaminate.without_contaminated(docs, items), [r for r in rows if r[0] != 3]),
        (toxicity.without_toxic(docs, labels), None),
        (pii.redacted(docs), rows),
    ):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert all([r[c] for c in ODD] == list(ODD.values()) for r in got)
        if want is not None:
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert {r.component_id for r in simhash.near_duplicates(docs).where("doc_id = 2").collect()} == {1}
    with pytest.raises(ValueError, match="another name"):
        simhash.near_duplicates(docs, key="fingerprint")


def test_overlap_rule():
    same = np.array([1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 0, 1, 1])
    assert decontaminate._best_overlap(same, 5, 0.8) == (9, 7)
    assert decontaminate._best_overlap(same[:4], 5, 0.8) == (0, 0)
    assert decontaminate._best_overlap(np.zeros(9, int), 5, 0.8) == (0, 0)
