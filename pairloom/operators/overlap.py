"""Corpus scores of prediction tables: BLEU, ROUGE, METEOR and their means.

Per pair the work is row-local; across pairs everything is additive, so each
score is one map-side combined aggregate and can be grouped by any column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.kernels import clipped_character_matches, clipped_matches, lcs_length, meteor
from pairloom.functions.lookups import TABLE_BYTES, mapped
from pairloom.functions.text import ratio
from pairloom.operators.digests import digest
from pairloom.operators.joins import frame_bytes, lookup_join
from pairloom.session import pinned


def with_overlap(
    df: DataFrame, reference: Column, hypothesis: Column, orders: int = 4, prefix: str = ""
) -> DataFrame:
    """Add token arrays ``ref`` / ``hyp``, their sizes ``ref_n`` / ``hyp_n`` and ``matches``, the shared n-gram counts."""
    ref, hyp = f"{prefix}ref", f"{prefix}hyp"
    return df.withColumn(ref, reference).withColumn(hyp, hypothesis).withColumns({
        f"{prefix}matches": clipped_matches(ref, hyp, orders), f"{ref}_n": F.size(ref), f"{hyp}_n": F.size(hyp)})


def with_character_overlap(df: DataFrame, reference: str, hypothesis: str, orders: int = 4, prefix: str = "") -> DataFrame:
    """Add ``matches``, ``ref_n`` and ``hyp_n`` of the characters of two text columns."""
    return df.withColumns({
        f"{prefix}matches": clipped_character_matches(reference, hypothesis, orders),
        f"{prefix}ref_n": F.length(reference), f"{prefix}hyp_n": F.length(hypothesis)})


def bleu(weights: tuple[float, ...], prefix: str = "") -> Column:
    """Corpus BLEU as an aggregate expression over :func:`with_overlap` rows.

    No smoothing: 0 when some order has no match at all. Each pair counts at
    least 1 in every denominator, as in the public corpus_bleu implementation.
    """
    ref_len, hyp_len = F.sum(f"{prefix}ref_n"), F.sum(f"{prefix}hyp_n")
    log_precision = F.lit(0.0)
    some_zero = F.lit(False)
    for n, weight in enumerate(weights, start=1):
        hits = F.sum(F.get(F.col(f"{prefix}matches"), n - 1))
        possible = F.sum(F.greatest(F.lit(1), F.col(f"{prefix}hyp_n") - (n - 1)))
        log_precision = log_precision + weight * F.ln(hits / possible)
        some_zero = some_zero | (hits == 0)
    brevity = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / F.nullif(hyp_len, F.lit(0))))
    return F.when(some_zero, F.lit(0.0)).otherwise(brevity * F.exp(log_precision))


BLEU2 = (0.5, 0.5)
BLEU4 = (0.25, 0.25, 0.25, 0.25)


def f_measure(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def rouge_n(n: int, prefix: str = "") -> dict[str, Column]:
    """Precision, recall and F of one pair from its shared n-grams; 0 where undefined."""
    hits = F.get(F.col(f"{prefix}matches"), n - 1)
    of_ref = F.greatest(F.lit(0), F.size(f"{prefix}ref") - (n - 1))
    of_hyp = F.greatest(F.lit(0), F.size(f"{prefix}hyp") - (n - 1))
    precision = F.coalesce(ratio(hits, of_hyp), F.lit(0.0))
    recall = F.coalesce(ratio(hits, of_ref), F.lit(0.0))
    return {"p": precision, "r": recall, "f": f_measure(precision, recall)}


def with_rouge_l(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Add the row's ROUGE-L ``rouge_l_p``, ``rouge_l_r``, ``rouge_l_f``."""
    scored = df.withColumn("_lcs", lcs_length(ref, hyp))
    precision = F.coalesce(ratio(F.col("_lcs"), F.size(hyp)), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("_lcs"), F.size(ref)), F.lit(0.0))
    return scored.select(
        *df.columns, precision.alias("rouge_l_p"), recall.alias("rouge_l_r"),
        f_measure(precision, recall).alias("rouge_l_f"),
    )


def with_meteor(df: DataFrame, ref: str = "ref", hyp: str = "hyp", **options) -> DataFrame:
    """Add the row's METEOR; tokens are compared in lower case."""
    return df.withColumn("meteor", meteor(ref, hyp, **options))


def with_word_forms(df: DataFrame, tokens: list[str], forms: DataFrame, key: str = "pair_id", max_bytes: int = TABLE_BYTES) -> DataFrame:
    """Add ``<tokens>_form`` for each token column: every lower-cased token's form in ``forms`` (word, form), itself without one.

    Of several forms of a word the first in order counts. A table of at most
    ``max_bytes``, measured, is looked up inside the row; of a larger one each row's
    distinct words are joined and put back. ``key`` tells the rows apart.
    """
    forms = pinned(forms.groupBy(F.lower("word").alias("word")).agg(F.min(F.lower("form")).alias("form")))
    lower = lambda c: F.transform(c, F.lower)
    if frame_bytes(forms) <= max_bytes:
        held = forms.toArrow()
        table = df.sparkSession.sparkContext.broadcast(dict(zip(held.column("word").to_pylist(), held.column("form").to_pylist(), strict=True)))
        return df.withColumns({f"{c}_form": mapped(lower(c), table) for c in tokens})
    every = F.array_distinct(F.concat(*[F.coalesce(lower(c), F.array().cast("array<string>")) for c in tokens]))
    words = df.select(key, F.explode(every).alias("word"))
    found = lookup_join(words, forms, "word", "inner", spread_by=[key])
    entries = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "form"))).alias("_forms"))
    joined = df.join(entries, key, "left")
    form = lambda t: F.coalesce(F.try_element_at("_forms", t), t)
    return joined.withColumns({f"{c}_form": F.transform(lower(c), form) for c in tokens}).drop("_forms")


def with_synonyms(df: DataFrame, tokens: str, synonyms: DataFrame, key: str = "pair_id", max_bytes: int = TABLE_BYTES) -> DataFrame:
    """Add ``<tokens>_synonyms``: for each lower-cased token the words that ``synonyms`` (word, synonym) lets it stand for.

    The table is looked up as in :func:`with_word_forms`.
    """
    pairs = synonyms.select(F.lower("word").alias("word"), F.lower("synonym").alias("synonym")).distinct()
    sets = pinned(pairs.groupBy("word").agg(F.sort_array(F.collect_list("synonym")).alias("synonyms")))
    lower = F.transform(tokens, F.lower)
    name = f"{tokens}_synonyms"
    if frame_bytes(sets) <= max_bytes:
        held = sets.toArrow()
        table = df.sparkSession.sparkContext.broadcast(dict(zip(held.column("word").to_pylist(), held.column("synonyms").to_pylist(), strict=True)))
        return df.withColumn(name, mapped(lower, table, each=False))
    words = df.select(key, F.explode(F.array_distinct(lower)).alias("word"))
    found = lookup_join(words, sets, "word", "inner", spread_by=[key])
    entries = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "synonyms"))).alias("_sets"))
    joined = df.join(entries, key, "left")
    return joined.withColumn(name, F.transform(lower, lambda t: F.try_element_at("_sets", t))).drop("_sets")


def with_meteor_stages(
    df: DataFrame, ref: str = "ref", hyp: str = "hyp", stems: DataFrame | None = None, synonyms: DataFrame | None = None,
    key: str = "pair_id", **options,
) -> DataFrame:
    """Add the row's METEOR with the stem and synonym stages that a word table is given for: ``stems`` (word, form), ``synonyms`` (word, synonym)."""
    columns, extra = df.columns, {}
    if stems is not None:
        df = with_word_forms(df, [ref, hyp], stems, key)
        extra["stems"] = (f"{ref}_form", f"{hyp}_form")
    if synonyms is not None:
        df = with_synonyms(df, hyp, synonyms, key)
        extra["synonyms"] = f"{hyp}_synonyms"
    return with_meteor(df, ref, hyp, **extra, **options).select(*columns, "meteor")


def levenshtein_mean(output: str, truth: str) -> Column:
    return F.avg(F.levenshtein(F.col(output), F.col(truth)))


def exact_rate(output: Column, truth: Column, valid: Column | None = None) -> Column:
    """Share of all rows whose two keys are equal; an invalid row never counts as equal."""
    same = output.eqNullSafe(truth) if valid is None else output.eqNullSafe(truth) & F.coalesce(valid, F.lit(False))
    return F.avg(same.cast("double"))


def validity_rate(valid: Column) -> Column:
    return F.avg(F.coalesce(valid, F.lit(False)).cast("double"))


def uniqueness_rate(output: Column, valid: Column, approximate: bool = False) -> Column:
    """Distinct valid outputs over valid outputs; NULL when none is valid. Digests are told apart, so no text is shuffled."""
    kept = F.when(valid, output)
    distinct = F.approx_count_distinct(kept) if approximate else F.count_distinct(F.when(kept.isNotNull(), digest(kept)))
    return ratio(distinct, F.count(kept))


def mean_similarity(similarity: Column, valid: Column) -> Column:
    """Mean in which an invalid or missing similarity counts as 0."""
    return F.avg(F.when(valid, F.coalesce(similarity, F.lit(0.0))).otherwise(0.0))


def tanimoto_from_matches(prefix: str = "") -> Column:
    """Count-fingerprint Tanimoto of the two token multisets, from the shared 1-gram count."""
    shared = F.get(F.col(f"{prefix}matches"), 0)
    return F.coalesce(
        ratio(shared, F.size(f"{prefix}ref") + F.size(f"{prefix}hyp") - shared), F.lit(0.0)
    )


