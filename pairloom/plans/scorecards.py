"""One-row (or per-group) scorecards of prediction tables, and long metric reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import alnum_words, truncated, without_special, words
from pairloom.operators import overlap, phrases
from pairloom.operators.retrieval import mean_paired_cosine, mean_unpaired_cosine

Tokenizer = Callable[[Column], Column]


def _summed(df: DataFrame, group_by: list[str], columns: dict[str, Column]) -> DataFrame:
    return df.groupBy(*group_by).agg(*[value.alias(name) for name, value in columns.items()])


def text_scorecard(
    pairs: DataFrame, tokens: Tokenizer = words, max_tokens: int | None = None, group_by: list[str] | None = None,
    tokenizer_name: str = "words", stems: DataFrame | None = None, synonyms: DataFrame | None = None, row_id: str = "pair_id",
) -> DataFrame:
    """BLEU-2, BLEU-4, METEOR and ROUGE-1/2/L of ``output`` against ``ground_truth``.

    METEOR runs its exact stage, and the stem and synonym stages when ``stems`` (word,
    form) and ``synonyms`` (word, synonym) are given; ``meteor_stages`` then names them.

    One scan; per-pair values are row-local, then one aggregate. BLEU and METEOR use
    ``tokens`` (cut at ``max_tokens``, special tokens dropped), ROUGE its own rule.
    Scores compare only within one tokenizer, so its name is part of the result.
    """
    stages = ["exact", *(name for name, table in (("stem", stems), ("synonym", synonyms)) if table is not None)]
    side = lambda c: without_special(truncated(tokens(F.col(c)), max_tokens))
    scored = overlap.with_overlap(pairs, side("ground_truth"), side("output"), 4)
    rouge = "" if tokens is alnum_words and max_tokens is None else "rouge_"
    if rouge:
        scored = overlap.with_overlap(scored, alnum_words("ground_truth"), alnum_words("output"), 2, rouge)
    scored = overlap.with_meteor_stages(scored, "ref", "hyp", stems, synonyms, row_id)
    scored = overlap.with_rouge_l(scored, f"{rouge}ref", f"{rouge}hyp")
    return _summed(scored, group_by or [], {
        "n_pairs": F.count("*"),
        "tokenizer": F.lit(tokenizer_name),
        "bleu2": overlap.bleu(overlap.BLEU2),
        "bleu4": overlap.bleu(overlap.BLEU4),
        "rouge1": F.avg(overlap.rouge_n(1, rouge)["f"]),
        "rouge2": F.avg(overlap.rouge_n(2, rouge)["f"]),
        "rouge_l": F.avg("rouge_l_f"),
        "meteor": F.avg("meteor"),
        **({"meteor_stages": F.lit("+".join(stages))} if len(stages) > 1 else {}),
    })


def bleu_scorecard(pairs: DataFrame, tokens: Tokenizer = words, group_by: list[str] | None = None) -> DataFrame:
    """BLEU-2 and BLEU-4, overall or per group."""
    scored = overlap.with_overlap(pairs, tokens(F.col("ground_truth")), tokens(F.col("output")), 4)
    return _summed(scored, group_by or [], {
        "n_pairs": F.count("*"), "bleu2": overlap.bleu(overlap.BLEU2), "bleu4": overlap.bleu(overlap.BLEU4),
    })


def rouge_scorecard(pairs: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Mean precision, recall and F of ROUGE-1 and ROUGE-2."""
    scored = overlap.with_overlap(pairs, alnum_words("ground_truth"), alnum_words("output"), 2)
    values = {f"rouge{n}_{part}": F.avg(v) for n in (1, 2) for part, v in overlap.rouge_n(n).items()}
    return _summed(scored, group_by or [], {"n_pairs": F.count("*"), **values})


def molecule_scorecard(
    pairs: DataFrame, key: Tokenizer = lambda c: c, valid: Column | None = None, group_by: list[str] | None = None
) -> DataFrame:
    """Character BLEU, exact-match rate, mean edit distance and validity of generated strings.

    ``key`` maps both sides to the form that exact match compares; ``valid`` is false
    for a row whose item cannot be processed.
    """
    ok = F.lit(True) if valid is None else valid
    scored = overlap.with_character_overlap(pairs, "ground_truth", "output", 4)
    return _summed(scored, group_by or [], {
        "n_pairs": F.count("*"),
        "char_bleu": overlap.bleu(overlap.BLEU4),
        "exact_match": overlap.exact_rate(key(F.col("output")), key(F.col("ground_truth")), ok),
        "levenshtein": overlap.levenshtein_mean("output", "ground_truth"),
        "validity": overlap.validity_rate(ok),
    })


def validity_scorecard(pairs: DataFrame, valid_truth: Column, valid_output: Column, group_by: list[str] | None = None) -> DataFrame:
    """The three validity rates and uniqueness: both sides valid; output valid;
    output valid, present and not empty."""
    present = valid_output & F.col("output").isNotNull() & (F.col("output") != "")
    return _summed(pairs, group_by or [], {
        "n_pairs": F.count("*"),
        "n_invalid": F.count_if(~F.coalesce(valid_output, F.lit(False))),
        "validity_both": overlap.validity_rate(valid_truth & valid_output),
        "validity_output": overlap.validity_rate(valid_output),
        "validity_kept": overlap.validity_rate(valid_truth & present),
        "uniqueness": overlap.uniqueness_rate(F.col("output"), valid_output),
    })


def fingerprint_scorecard(pairs: DataFrame, similarities: dict[str, Column], valid: Column, group_by: list[str] | None = None) -> DataFrame:
    """Validity, uniqueness and the mean of each named similarity; invalid rows count as 0."""
    return _summed(pairs, group_by or [], {
        "validity": overlap.validity_rate(valid),
        **{name: overlap.mean_similarity(value, valid) for name, value in similarities.items()},
        "uniqueness": overlap.uniqueness_rate(F.col("output"), valid),
    })


def embedding_scorecard(pairs: DataFrame) -> DataFrame:
    """Mean paired and mean unpaired cosine of (a, b)."""
    return mean_paired_cosine(pairs).withColumn("negative_similarity", mean_unpaired_cosine(pairs).scalar())


def property_report(pairs: DataFrame, properties: DataFrame, combos: DataFrame, tokens: Tokenizer = words, compat: bool = False) -> DataFrame:
    """Long table (metric, path, value): group means, overall means, held-out pair metrics."""
    groups = phrases.macro_average(phrases.confusion(pairs, properties, tokens))
    named = groups.withColumn("path", F.when(F.col("path") == "", F.lit("Overall")).otherwise(F.col("path")))
    counted = phrases.combo_confusion(pairs, combos, tokens, compat)
    held = counted.select(*phrases.METRICS).unpivot([], list(phrases.METRICS), "metric", "value")
    return named.unionByName(held.select("metric", F.lit("Held-Out Combo").alias("path"), "value"))
