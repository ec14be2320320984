"""Phrase hits in texts, confusion counts, hierarchical means and phrase-pair metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import automaton
from pairloom.functions.ngrams import ngrams
from pairloom.functions.text import PATH_SEPARATOR, last_segment, ratio, segments, words
from pairloom.operators.digests import distinct_rows
from pairloom.operators.joins import frame_bytes, lookup_join
from pairloom.session import pinned

Tokenizer = Callable[[Column], Column]
METRICS = ("accuracy", "precision", "recall", "f1")
# Size of a phrase table's values up to which every task holds it as a trie (some ten times as large).
TRIE_BYTES = 16 << 20


def phrase_key(path: Column | str, tokens: Tokenizer = words) -> Column:
    """The tokens of the path's leaf, joined by a space."""
    return F.array_join(tokens(last_segment(path)), " ")


def with_keys(properties: DataFrame, tokens: Tokenizer = words) -> DataFrame:
    """(path, key), one row per distinct path."""
    return properties.select("path").distinct().select("path", phrase_key("path", tokens).alias("key"))


def phrase_candidates(
    pairs: DataFrame, keys: DataFrame, sides: dict[str, Column], tokens: Tokenizer = words, row_id: str = "pair_id"
) -> DataFrame:
    """(row_id, side, key): the distinct n-grams of each text, of the phrases' lengths only.

    To be met by the phrases in an equi-join on ``key``; ``side`` counts the sides from 0.
    """
    sizes = F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", " ")))
    # A handful of numbers: the distinct phrase lengths.
    lengths = sorted(r[0] for r in keys.select(sizes.alias("n")).distinct().collect())
    texts = F.array(*[F.struct(F.lit(i).alias("side"), tokens(F.lower(c)).alias("tokens"))
                      for i, c in enumerate(sides.values())])
    of_text = pairs.select(row_id, F.explode(texts).alias("_t")).select(row_id, "_t.side", "_t.tokens")
    grams = F.concat(*[ngrams("tokens", n) for n in lengths if n > 0] or [F.array().cast("array<string>")])
    if 0 in lengths:
        grams = F.concat(grams, F.array(F.lit("")))
    return of_text.select(row_id, "side", F.explode(F.array_distinct(grams)).alias("key"))


def token_text(c: Column, tokens: Tokenizer = words) -> Column:
    """A text's lower-cased tokens joined by a space."""
    return F.array_join(tokens(F.lower(c)), " ")


def phrase_hits(
    pairs: DataFrame, keys: DataFrame, sides: dict[str, Column], tokens: Tokenizer = words, row_id: str = "pair_id",
    max_bytes: int | None = None,
) -> DataFrame:
    """(row_id, key, one boolean per side): the phrases each text contains contiguously.

    Pairs without a hit leave no row. A phrase table of at most ``max_bytes`` (default:
    ``TRIE_BYTES``), measured, walks over each text as a trie, and only hits become rows. A
    larger one meets the texts' n-grams in an equi-join.
    """
    keys = keys.select("key").distinct()
    if frame_bytes(keys) <= (TRIE_BYTES if max_bytes is None else max_bytes):
        shared = automaton.shared_phrases(pairs.sparkSession, keys.toArrow().column("key").to_pylist())
        found = F.explode(automaton.hits(shared, *[token_text(c, tokens) for c in sides.values()]))
        rows = pairs.select(row_id, found.alias("_h"))
        met = [(F.col("_h.sides").bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(sides)]
        return rows.select(row_id, "_h.key", *met)
    candidates = phrase_candidates(pairs, keys, sides, tokens, row_id)
    found = lookup_join(candidates, keys, "key", "left_semi", spread_by=[row_id, "side"])
    return found.groupBy(row_id, "key").agg(
        *[F.bool_or(F.col("side") == i).alias(name) for i, name in enumerate(sides)]
    )


def prediction_hits(pairs: DataFrame, keys: DataFrame, tokens: Tokenizer = words) -> DataFrame:
    """Hits in ``ground_truth`` (column ``gt``) and in ``output`` (column ``out``)."""
    return phrase_hits(pairs, keys, {"gt": F.col("ground_truth"), "out": F.col("output")}, tokens)


def confusion(pairs: DataFrame, properties: DataFrame, tokens: Tokenizer = words) -> DataFrame:
    """(path, tp, fn, fp, tn, accuracy, precision, recall, f1) per property path.

    Counts come from hits alone; the rest of the rows are true negatives.
    """
    keyed = with_keys(properties, tokens)
    counts = prediction_hits(pairs, keyed, tokens).groupBy("key").agg(
        F.count_if(F.col("gt") & F.col("out")).alias("tp"),
        F.count_if(F.col("gt") & ~F.col("out")).alias("fn"),
        F.count_if(~F.col("gt") & F.col("out")).alias("fp"),
    )
    rows = pairs.agg(F.count("*").alias("n")).scalar()
    filled = keyed.join(counts, "key", "left").select(
        "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fn", "fp")]
    )
    return with_ratios(filled.withColumn("tn", rows - F.col("tp") - F.col("fn") - F.col("fp")))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of tp / fn / fp / tn; NULL where undefined."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def check_tree(paths: DataFrame) -> None:
    """Raise when a path is both a leaf and a parent of another path."""
    parts = segments("path")
    parents = paths.where(F.size(parts) > 1).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), PATH_SEPARATOR)
    )).alias("path")).distinct()
    clash = paths.join(parents, "path", "left_semi").select("path").first()
    if clash:
        raise ValueError(f"path is both a leaf and a group: {clash[0]}")


def macro_average(per_path: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, path, value) for every group of the tree; the empty path is the overall mean.

    A group's value is the mean of its children, sub-groups and leaves alike; NULL
    leaves are left out, and a group without any value counts as 0.
    """
    check_tree(per_path)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    level = per_path.select(segments("path").alias("path"), F.explode(pairs).alias("_m"))
    # Pinned: every level below reads this small table instead of the texts.
    leaves = pinned(level.select("_m.metric", "path", "_m.value"))
    depth = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    groups, deeper = [], None
    for size in range(depth, 0, -1):
        children = leaves.where(F.size("path") == size)
        children = children if deeper is None else children.unionByName(deeper)
        deeper = children.groupBy("metric", F.slice("path", 1, size - 1).alias("path")).agg(
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("value")
        )
        groups.append(deeper)
    report = groups[0]
    for more in groups[1:]:
        report = report.unionByName(more)
    return report.select("metric", F.array_join("path", PATH_SEPARATOR).alias("path"), "value")


def nested(values: DataFrame, value: str, group_by: list[str] | None = None) -> DataFrame:
    """(group_by.., tree): the JSON object whose nested keys are the segments of ``path``, with ``value`` at its end.

    The tree is folded from the deepest level up, one aggregate per level; keys are in
    order. A path that is both a leaf and a group raises, and so does a path that occurs
    twice in a group. A tree is one value, so it must fit into a row.
    """
    by = group_by or []
    check_tree(values.select("path").distinct())
    json = F.coalesce(F.to_json(F.struct(F.col(value).alias("v")), {"ignoreNullFields": "false"}), F.lit('{"v":null}'))
    nodes = pinned(values.select(*by, segments("path").alias("_path"), F.regexp_extract(json, r"(?s)^\{\"v\":(.*)\}$", 1).alias("_json")))
    twice = nodes.groupBy(*by, "_path").count().where("count > 1").first()
    if twice:
        raise ValueError(f"path occurs twice: {PATH_SEPARATOR.join(twice['_path'])}")
    depth = nodes.agg(F.max(F.size("_path"))).first()[0] or 0
    name = F.regexp_extract(F.to_json(F.array(F.element_at("_path", -1))), r"(?s)^\[(.*)\]$", 1)
    folded = None
    for size in range(depth, 0, -1):
        level = nodes.where(F.size("_path") == size)
        level = level if folded is None else level.unionByName(folded)
        entry = F.struct(F.element_at("_path", -1).alias("key"), F.concat(name, F.lit(":"), F.col("_json")).alias("text"))
        entries = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"])
        folded = level.groupBy(*by, F.slice("_path", 1, size - 1).alias("_path")).agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("_json"))
    if folded is None:
        return nodes.select(*by, F.col("_json").alias("tree"))
    return folded.select(*by, F.col("_json").alias("tree"))


def combo_keys(combos: DataFrame, tokens: Tokenizer = words) -> DataFrame:
    """(combo_id, key1, key2) of (combo_id, p1, p2)."""
    return combos.select("combo_id", phrase_key("p1", tokens).alias("key1"), phrase_key("p2", tokens).alias("key2"))


def _shared_combos(keyed: DataFrame, max_bytes: int | None):
    """The pairs of phrases for every task, or None when they are larger than the bound."""
    if frame_bytes(keyed) > (TRIE_BYTES if max_bytes is None else max_bytes):
        return None
    held = keyed.toArrow()
    return automaton.shared_pairs(keyed.sparkSession, list(zip(held.column("key1").to_pylist(), held.column("key2").to_pylist(), strict=True)))


def combo_hits(
    pairs: DataFrame, combos: DataFrame, sides: dict[str, Column], tokens: Tokenizer = words, row_id: str = "pair_id"
) -> DataFrame:
    """(row_id, combo_id, <side>1, <side>2 ..): which of a combo's two phrases each side contains.

    Both phrases meet the texts in one join and fold into one row per text and combo,
    already inside the task that read the text; no hit table is joined with itself.
    """
    place = F.posexplode(F.array(phrase_key("p1", tokens), phrase_key("p2", tokens))).alias("place", "key")
    roles = combos.select("combo_id", place)
    candidates = phrase_candidates(pairs, roles.select("key").distinct(), sides, tokens, row_id)
    met = lookup_join(candidates, roles, "key", "inner", spread_by=[row_id, "side"])
    return met.groupBy(row_id, "combo_id").agg(*[
        F.bool_or((F.col("side") == i) & (F.col("place") == p)).alias(f"{name}{p + 1}")
        for i, name in enumerate(sides) for p in (0, 1)
    ])


def combo_confusion(
    pairs: DataFrame, combos: DataFrame, tokens: Tokenizer = words, compat: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """One row of counts over all texts and phrase pairs, with the four ratios.

    ``compat`` counts a true negative whenever the second phrase is predicted or the
    first is not, for rows whose truth lacks the pair: the published scores' rule.
    """
    shared = _shared_combos(combo_keys(combos, tokens), max_bytes)
    if shared:
        # Pairs are counted inside the row that holds both texts: no row per text and pair.
        row = pairs.select(automaton.pair_counts(shared, token_text(F.col("ground_truth"), tokens), token_text(F.col("output"), tokens)).alias("_c"))
        counts = row.agg(*[F.coalesce(F.sum(f"_c.{c}"), F.lit(0)).alias("_half" if c == "half" else c) for c in ("tp", "fn", "fp", "half")])
    else:
        hits = combo_hits(pairs, combos, {"gt": F.col("ground_truth"), "out": F.col("output")}, tokens)
        gt, out = F.col("gt1") & F.col("gt2"), F.col("out1") & F.col("out2")
        counts = hits.agg(
            F.count_if(gt & out).alias("tp"),
            F.count_if(gt & ~out).alias("fn"),
            F.count_if(~gt & out).alias("fp"),
            # Only the first phrase predicted, no true pair: counted nowhere under ``compat``.
            F.count_if(~gt & F.col("out1") & ~F.col("out2")).alias("_half"),
        )
    cells = pairs.agg(F.count("*").alias("n")).scalar() * combos.agg(F.count("*").alias("n")).scalar()
    left_out = F.col("_half") if compat else F.col("fp")
    return with_ratios(counts.withColumn("tn", cells - F.col("tp") - F.col("fn") - left_out).drop("_half"))


def heldout_rows(
    pairs: DataFrame, combos: DataFrame, on: str = "ground_truth", tokens: Tokenizer = words, max_bytes: int | None = None
) -> DataFrame:
    """Distinct (source, ground_truth, output) whose ``on`` text has both phrases of some pair.

    Rows are kept or dropped where they are read; equal ones are found by a digest, so
    only the kept rows' digests and ids are shuffled.
    """
    shared = _shared_combos(combo_keys(combos, tokens), max_bytes)
    if shared:
        kept = pairs.where(automaton.has_pair(shared, token_text(F.col(on), tokens)))
    else:
        hits = combo_hits(pairs, combos, {"hit": F.col(on)}, tokens)
        whole = hits.where(F.col("hit1") & F.col("hit2")).select("pair_id").distinct()
        kept = lookup_join(pairs, whole, "pair_id", "left_semi", spread_by=["pair_id"])
    return distinct_rows(kept, ["source", "ground_truth", "output"], "pair_id").select("source", "ground_truth", "output")
