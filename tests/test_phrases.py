import itertools
import json
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pairloom.functions.text import contains_phrase, last_segment, words
from pairloom.operators import phrases
from pairloom.plans import scorecards
from pairloom.sources.readers import flat_tree


@pytest.fixture
def combo_table(spark):
    """All 16 settings of gt1, gt2, out1, out2, the k-th one k + 1 times."""
    rows = []
    for k, (g1, g2, o1, o2) in enumerate(itertools.product([0, 1], repeat=4)):
        text = lambda a, b: " ".join(["x"] + ["p one"] * a + ["y"] + ["q"] * b)
        rows += [(len(rows) + i, text(g1, g2), text(o1, o2)) for i in range(k + 1)]
    return spark.createDataFrame(rows, "pair_id long, ground_truth string, output string")


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("compat", [False, True])
def test_combo_truth_table(spark, combo_table, compat, limit):
    combos = spark.createDataFrame([(0, "c__P One", "d__q")], "combo_id long, p1 string, p2 string")
    got = phrases.combo_confusion(combo_table, combos, compat=compat, max_bytes=limit).first()
    want = dict(tp=0, fn=0, fp=0, tn=0)
    for k, (g1, g2, o1, o2) in enumerate(itertools.product([0, 1], repeat=4)):
        n, g, o = k + 1, g1 and g2, o1 and o2
        want["tp"] += n * bool(g and o)
        want["fn"] += n * bool(g and not o)
        want["fp"] += n * bool(not g and o)
        want["tn"] += n * bool(not g and ((not o1 or o2) if compat else not o))
    assert {k: got[k] for k in want} == want
    if not compat:
        assert sum(want.values()) == combo_table.count()


@pytest.mark.parametrize("limit", [None, 0])
def test_hits_equal_nested_loop(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(phrases, "TRIE_BYTES", limit)
    texts = [(0, "b c a"), (1, "ab c"), (2, "c b c"), (3, ""), (4, "a a, a")]
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in texts], "pair_id long, ground_truth string, output string")
    paths = spark.createDataFrame([("k__b c",), ("k__",), ("m__b c",), ("m__a a , a",), ("k__zz",)], "path string")
    keyed = phrases.with_keys(paths)
    got = {(r.pair_id, r.key): (r.gt, r.out) for r in phrases.prediction_hits(df, keyed).collect()}
    test = lambda c: contains_phrase(words(last_segment("path")), words(c))
    loop = df.join(paths).select("pair_id", phrases.phrase_key("path").alias("key"), test("ground_truth").alias("gt"), test("output").alias("out"))
    want = {(r.pair_id, r.key): (r.gt, r.out) for r in loop.collect() if r.gt or r.out}
    assert got == want and (3, "") in got


@pytest.mark.parametrize("limit", [None, 0])
def test_phrase_paths_agree(spark, limit):
    """Trie and n-gram join against containment of every phrase in every text, nulls and overlaps included."""
    draw = random.Random(6)
    text = lambda: draw.choice([None, "", " ".join(draw.choices(["a", "b", "A", "ab", "é", ",", "a  b"], k=draw.randrange(12)))])
    rows = [(i, text(), text()) for i in range(80)]
    df = spark.createDataFrame(rows, "pair_id long, ground_truth string, output string").repartition(3)
    keys = ["", "a", "a b", "a b a", "b a b", "ab", "a a a", ", a", "é", "zz", "a b a b a"]
    frame = spark.createDataFrame([(k,) for k in keys + keys[:3]], "key string")
    split = lambda t: re.findall(r"[^\W_]+|\S", t.lower())
    inside = lambda k, t: t is not None and f" {k} " in f" {' '.join(split(t))} " if k else t is not None
    got = {(r.pair_id, r.key): (r.gt, r.out) for r in phrases.phrase_hits(df, frame, {"gt": F.col("ground_truth"), "out": F.col("output")}, max_bytes=limit).collect()}
    want = {(i, k): (inside(k, a), inside(k, b)) for i, a, b in rows for k in keys}
    assert got == {at: v for at, v in want.items() if any(v)}
    combos = spark.createDataFrame([(n, f"g__{a}", f"h__{b}") for n, (a, b) in enumerate(itertools.permutations(["a b", "é", "", "a", "zz"], 2))], "combo_id long, p1 string, p2 string")
    pairs_of = [tuple(c.split("__")[1] for c in (r.p1, r.p2)) for r in combos.collect()]
    kept = phrases.heldout_rows(df.withColumn("source", F.lit("s")), combos, max_bytes=limit).collect()
    assert sorted(map(str, kept)) == sorted(str(Row(source="s", ground_truth=a, output=b)) for a, b in {
        (a, b) for i, a, b in rows if any(inside(x, a) and inside(y, a) for x, y in pairs_of)})
    scores = phrases.combo_confusion(df, combos, max_bytes=limit).first()
    cells = [(inside(x, a) and inside(y, a), inside(x, b) and inside(y, b)) for _, a, b in rows for x, y in pairs_of]
    assert (scores.tp, scores.fn, scores.fp, scores.tn) == tuple(cells.count(c) for c in ((True, True), (True, False), (False, True), (False, False)))


def test_no_rows_without_a_hit(spark):
    df = spark.createDataFrame([(0, "x y", "y")], "pair_id long, ground_truth string, output string")
    keys = spark.createDataFrame([("y",)], "key string")
    plan = phrases.prediction_hits(df, keys)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "Join" not in plan and "Exchange" not in plan
    assert phrases.prediction_hits(df, keys.limit(0)).count() == 0


def test_confusion_counts(spark):
    df = spark.createDataFrame(
        [(0, "a b", "a"), (1, "a", "b"), (2, "c", "c")], "pair_id long, ground_truth string, output string")
    props = spark.createDataFrame([("x__a",), ("y__a",), ("x__b",), ("x__zz",), ("x__a",)], "path string")
    got = {r.path: r for r in phrases.confusion(df, props).collect()}
    assert len(got) == 4
    assert (got["x__a"].tp, got["x__a"].fn, got["x__a"].fp, got["x__a"].tn) == (1, 1, 0, 1)
    assert (got["y__a"].tp, got["x__b"].fp, got["x__zz"].tn) == (1, 1, 3)
    assert got["x__zz"].precision is None and got["x__zz"].accuracy == 1.0
    assert all(r.tp + r.fn + r.fp + r.tn == 3 for r in got.values())


def recursive_mean(tree):
    values = [recursive_mean(v) if isinstance(v, dict) else v for v in tree.values()]
    kept = [v for v in values if v is not None]
    return sum(kept) / len(kept) if kept else 0.0


def test_macro_average_mixed_depth(spark):
    tree = {"a": {"l1": 0.5, "s": {"l2": 1.0, "t": {"l3": None}}}, "b": {"l4": None}, "c": {"l5": 0.25, "l6": None}}
    rows = [("a__l1", 0.5), ("a__s__l2", 1.0), ("a__s__t__l3", None), ("b__l4", None), ("c__l5", 0.25), ("c__l6", None)]
    df = spark.createDataFrame(rows, "path string, f1 double")
    got = {r.path: r.value for r in phrases.macro_average(df, ("f1",)).collect()}
    assert got[""] == pytest.approx(recursive_mean(tree))
    assert got["a__s"] == pytest.approx(0.5) and got["b"] == 0.0 and got["c"] == 0.25


def test_leaf_and_group_clash(spark):
    df = spark.createDataFrame([("a__b", 1.0), ("a__b__c", 1.0)], "path string, f1 double")
    with pytest.raises(ValueError, match="both a leaf and a group"):
        phrases.macro_average(df, ("f1",))


def test_heldout(spark):
    df = spark.createDataFrame(
        [(0, "s", "p q", "o"), (1, "s", "p q", "o"), (2, "p and q", "p", "o"), (3, "t", "q", "p q")],
        "pair_id long, source string, ground_truth string, output string")
    combos = spark.createDataFrame([(0, "k__p", "k__q"), (1, "k__q", "k__zz")], "combo_id long, p1 string, p2 string")
    assert [tuple(r) for r in phrases.heldout_rows(df, combos).collect()] == [("s", "p q", "o")]
    assert [r.source for r in phrases.heldout_rows(df, combos, on="source").collect()] == ["p and q"]
    props = combos.select(F.explode(F.array("p1", "p2")).alias("path"))
    report = {(r.metric, r.path): r.value for r in scorecards.property_report(df, props, combos).collect()}
    assert {p for _, p in report} == {"Overall", "k", "Held-Out Combo"} and len(report) == 12


def test_flat_tree_depths(spark):
    tree = {"a": ["x", {"s": ["y", {"t": ["z"]}]}], "b": ["x"]}
    df = spark.createDataFrame([(json.dumps(tree),)], "tree string")
    got = sorted(r.path for r in flat_tree(df, "tree").collect())
    assert got == ["a__s__t__z", "a__s__y", "a__x", "b__x"]


def test_flat_tree_takes_object_keys_and_refuses_other_leaves(spark):
    paths = lambda tree: sorted(r.path for r in flat_tree(spark.createDataFrame([(json.dumps(tree),)], "tree string"), "tree").collect())
    assert paths({"a": {"s": ["y"], "t": ["z"]}, "b": ["x", {"c": {"d": 1}}]}) == ["a__s", "a__t", "b__c__d", "b__x"]
    for tree in ({"b": ["z", 3]}, {"b": ["z", None]}, {"b": "z"}, {"b": [["z"]]}):
        with pytest.raises(Exception, match="in the tree"):
            paths(tree)


def test_nested_undoes_flat_tree(spark):
    draw = random.Random(8)

    def grown(depth, names):
        entries = [f"{draw.choice('abé')}\"{n}" for n in range(draw.randrange(1, 4))]
        return entries + ([{f"g{next(names)}": grown(depth - 1, names)} for _ in range(draw.randrange(1, 3))] if depth else [])

    for depth in range(4):
        names = itertools.count()
        tree = {f"top{k}": grown(depth, names) for k in range(3)}
        rows = flat_tree(spark.createDataFrame([(1, json.dumps(tree))], "id int, tree string"), "tree", ["id"])
        back = phrases.nested(rows.select("id", "path", "leaf"), "leaf", ["id"]).first()

        def as_maps(entries):
            out = {e: e for e in entries if isinstance(e, str)}
            for e in entries:
                if isinstance(e, dict):
                    out |= {k: as_maps(v) for k, v in e.items()}
            return out

        assert json.loads(back.tree) == {k: as_maps(v) for k, v in tree.items()}


def test_nested_values_and_errors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "metric string, path string, value double")
    got = phrases.nested(frame([("f", "a__b", 0.5), ("f", "a__c", None), ("f", "x", 1.0), ("g", "d__b__c", 2.0)]), "value", ["metric"])
    assert {r.metric: json.loads(r.tree) for r in got.collect()} == {"f": {"a": {"b": 0.5, "c": None}, "x": 1.0}, "g": {"d": {"b": {"c": 2.0}}}}
    with pytest.raises(ValueError, match="both a leaf and a group"):
        phrases.nested(frame([("f", "a", 1.0), ("f", "a__b", 1.0)]), "value")
    with pytest.raises(ValueError, match="twice"):
        phrases.nested(frame([("f", "a", 1.0), ("f", "a", 1.0)]), "value")
    assert phrases.nested(frame([]), "value").count() == 0


def test_flat_tree_is_one_pass(spark):
    df = spark.createDataFrame([(1, '{"a": ["x"]}')], "id int, tree string")
    plan = flat_tree(df, "tree", ["id"])._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count("Generate") == 1 and "Union" not in plan
    for bad in ('{"a": [1]}', '{"a": "x"}', '["x"]', '{"a": ["x"], "a": ["y"]}', "{"):
        with pytest.raises(Exception):
            flat_tree(df.withColumn("tree", F.lit(bad)), "tree").collect()
    assert flat_tree(df.withColumn("tree", F.lit(None).cast("string")), "tree").count() == 0
