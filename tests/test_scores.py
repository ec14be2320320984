import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import kernels
from pairloom.functions.text import alnum_words
from pairloom.operators import overlap
from pairloom.plans import scorecards

tokens = st.lists(st.sampled_from("abc"), max_size=12)


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(tokens, tokens), min_size=1, max_size=6))
def test_clip_equals_counters(rows):
    lists = pa.list_(pa.string())
    got = kernels._clip(pa.array([a for a, _ in rows], lists), pa.array([b for _, b in rows], lists), 4)
    want = [[sum((grams(a, n) & grams(b, n)).values()) for n in range(1, 5)] for a, b in rows]
    assert got.tolist() == want


@settings(deadline=None, max_examples=150)
@given(tokens, tokens)
def test_lcs_equals_table(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert kernels._lcs(a, b) == table[-1, -1]


def plain_bleu(pairs, weights):
    hits, total = [0] * len(weights), [0] * len(weights)
    for ref, hyp in pairs:
        for n in range(1, len(weights) + 1):
            hits[n - 1] += sum((grams(ref, n) & grams(hyp, n)).values())
            total[n - 1] += max(1, len(hyp) - n + 1)
    if 0 in hits:
        return 0.0
    r, h = sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs)
    brevity = 1.0 if h > r else math.exp(1 - r / h)
    return brevity * math.exp(sum(w * math.log(Fraction(a, b)) for w, a, b in zip(weights, hits, total)))


CASES = {
    "partial": [("a b c d e f", "a b c d x f"), ("g h i j", "g h i j k"), ("q", "")],
    "short": [("a b c", "a b c"), ("d e f g h", "d e f g h")],
    "no common": [("a b c d", "e f g h")],
    "identical": [("a b c d e", "a b c d e")],
}


def frame(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "pair_id long, ground_truth string, output string")


@pytest.mark.parametrize("name", CASES)
def test_bleu(spark, name):
    row = scorecards.bleu_scorecard(frame(spark, CASES[name])).first()
    split = [(a.split(), b.split()) for a, b in CASES[name]]
    assert row.bleu2 == pytest.approx(plain_bleu(split, (0.5, 0.5)), abs=1e-12)
    assert row.bleu4 == pytest.approx(plain_bleu(split, (0.25,) * 4), abs=1e-12)
    if name == "identical":
        assert row.bleu4 == pytest.approx(1.0)


def test_bleu_reference_value(spark):
    """64-word fixture at sf0.01, checked against an independent count."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = docs.select("doc_id", F.slice(alnum_words("text"), 1, 64).alias("g")).where(F.size("g") > 0)
    out = F.when(F.col("doc_id") % 7 == 0, F.col("g")).otherwise(F.filter("g", lambda _, i: i % 5 != 4))
    pairs = t.select(F.array_join("g", " ").alias("ground_truth"), F.array_join(out, " ").alias("output"))
    assert scorecards.bleu_scorecard(pairs).first().bleu4 == pytest.approx(0.5524484328675849, abs=1e-12)


def test_rouge_golden(spark):
    df = frame(spark, [("the cat sat on the mat", "the cat lay on a mat"), ("x", "")])
    row = scorecards.rouge_scorecard(df.where("pair_id = 0")).first()
    assert (row.rouge1_p, row.rouge1_r) == (pytest.approx(4 / 6), pytest.approx(4 / 6))
    assert row.rouge2_f == pytest.approx(1 / 5)
    longest = overlap.with_rouge_l(overlap.with_overlap(df, alnum_words("ground_truth"), alnum_words("output"), 1))
    got = {r.pair_id: r.rouge_l_f for r in longest.collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 0.0}


def test_rouge_f_is_symmetric(spark):
    pairs = CASES["partial"]
    a = scorecards.rouge_scorecard(frame(spark, pairs)).first()
    b = scorecards.rouge_scorecard(frame(spark, [(y, x) for x, y in pairs])).first()
    assert a.rouge1_f == pytest.approx(b.rouge1_f) and a.rouge2_f == pytest.approx(b.rouge2_f)


def test_characters_clip_like_their_arrays(spark):
    rows = [("abcabc", "abcab"), ("", "a"), ("é🎉é🎉", "🎉é"), (None, "a"), ("a", None), ("aaaa", "aa"), ("same text", "same text")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string").repartition(2)
    split = lambda c: F.split(F.col(c), "")
    texts = df.where("x <> '' and y is not null")
    got = {r.i: (r.matches, r.ref_n, r.hyp_n) for r in overlap.with_character_overlap(df, "x", "y").collect()}
    want = {r.i: (r.matches, r.ref_n, r.hyp_n) for r in overlap.with_overlap(texts, split("x"), split("y")).collect()}
    assert {i: got[i] for i in want} == want and got[1] == ([0] * 4, 0, 1) and got[3][0] == got[4][0] == [0] * 4


def test_meteor_golden():
    ref, hyp = "the cat sat on the mat".split(), "on the mat sat the cat".split()
    exact = kernels._meteor(ref, hyp, None, None, None, 0.9, 3.0, 0.5)
    # Greedy from the end: 6 matches in 4 runs.
    pairs, _, _ = kernels._match_keys(hyp, ref, list(range(6)), list(range(6)))
    assert len(pairs) == 6
    assert 0 < exact < 1
    same = kernels._meteor(ref, ref, None, None, None, 0.9, 3.0, 0.5)
    assert same == pytest.approx(1 - 0.5 * (1 / 6) ** 3)
    assert kernels._meteor(["a"], ["b"], None, None, None, 0.9, 3.0, 0.5) == 0.0
    assert kernels._meteor([], [], None, None, None, 0.9, 3.0, 0.5) == 0.0


def test_meteor_stages(spark):
    df = spark.createDataFrame(
        [(["cats", "run", "big"], ["cat", "run", "large"], ["cat", "run", "big"], ["cat", "run", "large"], [[], [], ["large", "big"]])],
        "ref array<string>, hyp array<string>, rs array<string>, hs array<string>, syn array<array<string>>")
    exact = overlap.with_meteor(df).first().meteor
    stem = overlap.with_meteor(df, stems=("rs", "hs")).first().meteor
    full = overlap.with_meteor(df, stems=("rs", "hs"), synonyms="syn").first().meteor
    only_syn = overlap.with_meteor(df, synonyms="syn").first().meteor
    assert exact < only_syn < full and exact < stem < full
    assert full == pytest.approx(1 - 0.5 * (1 / 3) ** 3)


@pytest.mark.parametrize("limit", [None, 0])
def test_meteor_tables(spark, monkeypatch, limit):
    """Word tables held by the tasks or joined give the arrays that a caller would build by hand."""
    if limit is not None:
        for f in (overlap.with_word_forms, overlap.with_synonyms):
            monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], limit))
    df = spark.createDataFrame(
        [(1, ["cats", "run", "Big"], ["cat", "runs", "large"]), (2, [], ["x"]), (3, ["a"], []), (4, ["a", "b"], ["b", "a"]), (5, None, ["a"])],
        "pair_id long, ref array<string>, hyp array<string>").repartition(2)
    stems = spark.createDataFrame([("cats", "cat"), ("Runs", "run"), ("runs", "runz")], "word string, form string")
    synonyms = spark.createDataFrame([("Large", "big"), ("large", "huge"), ("large", "big")], "word string, synonym string")
    forms = {r.pair_id: (r.ref_form, r.hyp_form) for r in overlap.with_word_forms(df, ["ref", "hyp"], stems).collect()}
    assert forms[1] == (["cat", "run", "big"], ["cat", "run", "large"]) and forms[4] == (["a", "b"], ["b", "a"]) and forms[2] == ([], ["x"])
    sets = {r.pair_id: r.hyp_synonyms for r in overlap.with_synonyms(df, "hyp", synonyms).collect()}
    assert sets[1] == [None, None, ["big", "huge"]] and sets[4] == [None, None]
    score = lambda **k: {r.pair_id: r.meteor for r in overlap.with_meteor_stages(df, **k).collect()}
    full = 1 - 0.5 * (1 / 3) ** 3
    assert score()[1] == 0 and score(stems=stems, synonyms=synonyms)[1] == pytest.approx(full) and 0 < score(stems=stems)[1] < full
    assert score(stems=stems, synonyms=synonyms)[2] == score()[3] == score(stems=stems)[5] == 0


def test_scorecard_names_its_stages(spark):
    df = spark.createDataFrame([(1, "the cats run", "the cat runs")], "pair_id long, ground_truth string, output string")
    stems = spark.createDataFrame([("cats", "cat"), ("runs", "run")], "word string, form string")
    plain, staged = scorecards.text_scorecard(df).first(), scorecards.text_scorecard(df, stems=stems).first()
    assert staged.meteor_stages == "exact+stem" and staged.meteor > plain.meteor and plain.tokenizer == "words" and "meteor_stages" not in plain


def test_wordpiece(spark):
    cut = kernels.wordpiece_tokenizer(["un", "##aff", "##able", "a"])
    df = spark.createDataFrame([(["unaffable", "a", "zz"],)], "t array<string>")
    assert df.select(cut(F.col("t"))).first()[0] == ["un", "##aff", "##able", "a", "[UNK]"]


def test_validity_and_uniqueness(spark):
    df = spark.createDataFrame(
        [("a", "a", True), ("b", "a", True), ("c", "c", False), ("d", "", True)], "ground_truth string, output string, ok boolean")
    row = scorecards.validity_scorecard(df, F.col("ground_truth") != "b", F.col("ok")).first()
    assert (row.n_invalid, row.validity_both, row.validity_output, row.validity_kept) == (1, 0.5, 0.75, 0.25)
    assert row.uniqueness == pytest.approx(2 / 3)
    none = df.agg(overlap.uniqueness_rate(F.col("output"), F.lit(False)).alias("u")).first()
    assert none.u is None
    card = scorecards.molecule_scorecard(df.withColumn("pair_id", F.lit(1)), valid=F.col("ok")).first()
    assert (card.exact_match, card.validity, card.levenshtein) == (0.25, 0.75, 0.5)
    prints = scorecards.fingerprint_scorecard(df, {"s": F.lit(1.0)}, F.col("ok")).first()
    assert prints.s == 0.75


def test_scorecard_with_truncation_and_groups(spark):
    df = frame(spark, CASES["partial"]).withColumn("g", F.col("pair_id") % 2)
    cut = scorecards.text_scorecard(df, max_tokens=3).first()
    assert cut.bleu2 != scorecards.text_scorecard(df).first().bleu2
    assert scorecards.text_scorecard(df, group_by=["g"]).count() == 2
    ceiling = scorecards.text_scorecard(df.withColumn("output", F.col("ground_truth"))).first()
    assert ceiling.rouge_l == pytest.approx(1.0) and ceiling.rouge1 == pytest.approx(1.0)
