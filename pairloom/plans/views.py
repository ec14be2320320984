"""Input views derived from the given tables; every row and whole texts are kept.

The tables carry no model outputs, so ``output`` is derived from the text by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.ngrams import ngrams
from pairloom.functions.text import PATH_SEPARATOR, alnum_words
from pairloom.operators import pairs as P
from pairloom.sources.readers import read_table


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents", "doc_id")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations", "conv_id")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings", "vec_id")


def eval_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, lang, source, ground_truth, output, valid): a document's text, and the same text with
    every fifth word left out (except in each seventh document, an exact prediction).

    ``source`` is the text after its language, so that the two sides of a pair differ.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, d).select(
        F.col("doc_id").alias("pair_id"), "lang", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), text).alias("source"),
        text.alias("ground_truth"))
    thinned = F.regexp_replace("ground_truth", "((?:[^ ]+ ){3}[^ ]+) [^ ]+", "$1")
    return docs.select(
        *docs.columns, F.when(F.col("pair_id") % 7 == 0, F.col("ground_truth")).otherwise(thinned).alias("output"),
        (F.col("pair_id") % 11 != 0).alias("valid"),
    )


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, role, source, ground_truth, output): each turn with the turn that follows it."""
    turns = conversations(spark, d)
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return turns.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"), "role",
        F.col("role").alias("source"), F.col("text").alias("ground_truth"), "output",
    )


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, molecule, caption)."""
    return eval_pairs(spark, d).select("pair_id", F.col("source").alias("molecule"), F.col("ground_truth").alias("caption"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, predicted)."""
    return eval_pairs(spark, d).select("pair_id", F.col("output").alias("predicted"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Preference triples of both directions; (pair_id, task) is the key of a row."""
    return P.triples_by_direction(text_pairs(spark, d), predictions(spark, d))


def raw_outputs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, output) as collectors print them: a one-element list, some with a mark or a line end."""
    mark = F.when(F.col("pair_id") % 3 == 0, F.lit("[CLS] ")).otherwise("")
    end = F.when(F.col("pair_id") % 4 == 0, F.lit("\\n")).otherwise("")
    word = F.when(F.col("pair_id") % 5 == 0, F.lit("assistant ")).otherwise("")
    return eval_pairs(spark, d).select(
        "pair_id", F.concat(mark, F.lit("['"), word, "output", F.lit("#"), end, F.lit("']")).alias("output"))


def properties(spark: SparkSession, d: str) -> DataFrame:
    """(prop_id, path, leaf): every word and every pair of neighbouring words of each benchmark text, under a small tree.

    The phrases of one text are numbered in the order of their places, words before pairs.
    """
    item = F.col("item_id")
    tokens = read_table(spark, d, "benchmark", "item_id").select(item, alnum_words("text").alias("_t"))
    phrases = F.array_distinct(F.concat(ngrams("_t", 1), ngrams("_t", 2)))
    tokens = tokens.select(item, F.posexplode(phrases).alias("_n", "_leaf"))
    leaf = F.col("_leaf")
    group = F.concat(F.lit("cat"), item % 3)
    sub = F.when(item % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(f"{PATH_SEPARATOR}sub"), item % 2))
    return tokens.select(
        (item * 100000 + F.col("_n")).alias("prop_id"), F.concat(group, sub, F.lit(PATH_SEPARATOR), leaf).alias("path"), leaf.alias("leaf"))


def property_trees(spark: SparkSession, d: str) -> DataFrame:
    """(prop_id, tree): one nested JSON object per property."""
    item = F.floor(F.col("prop_id") / 100000)
    leaf = F.array("leaf")
    group = F.concat(F.lit("cat"), item % 3)
    nested = F.to_json(F.create_map(group, F.array(F.create_map(F.concat(F.lit("sub"), item % 2), leaf))))
    flat = F.to_json(F.create_map(group, leaf))
    return properties(spark, d).select("prop_id", F.when(item % 4 == 0, flat).otherwise(nested).alias("tree"))


def combos(spark: SparkSession, d: str) -> DataFrame:
    """(combo_id, p1, p2): each phrase of two words with the next one of the same text."""
    p = properties(spark, d).where(F.contains("leaf", F.lit(" ")))
    nxt = p.select((F.col("prop_id") - 1).alias("prop_id"), F.col("path").alias("p2"))
    return p.join(nxt, "prop_id").select(F.col("prop_id").alias("combo_id"), F.col("path").alias("p1"), "p2")


def vec_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, a, b): each vector with the next one."""
    v = embeddings(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    return v.join(nxt, "vec_id").select(F.col("vec_id").alias("pair_id"), F.col("v").alias("a"), "b")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """(query, vec): the mean vector of each label."""
    exploded = embeddings(spark, d).select("label", F.posexplode("embedding").alias("d", "x"))
    means = exploded.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    grouped = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v"))
    return grouped.select(F.col("label").alias("query"), F.transform("v", lambda e: e["x"]).alias("vec"))


def word_table(spark: SparkSession, d: str, counts: DataFrame) -> DataFrame:
    """(word, vec): words that are not rare, each with the embedding its count points to."""
    v = embeddings(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    size = v.agg(F.count("*").alias("n")).scalar()
    pointed = counts.where(F.col("n") > 3).select("word", (F.col("n") % size).alias("vec_id"))
    return pointed.join(v, "vec_id").select("word", "vec")
