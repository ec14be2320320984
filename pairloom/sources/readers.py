"""Readers of pair, prediction, tree, combo, vector, corpus and record files."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import PATH_SEPARATOR, spaced_words, strip, without_leading_mark
from pairloom.functions.trees import tree_leaves
from pairloom.operators.pairs import DIRECTIONS

PAIR_COLUMNS = ("molecule", "caption")
TRIPLE_COLUMNS = ("source", "chosen", "rejected")


_SPLIT = ("_file", "_block")


def _placed(scan: DataFrame) -> DataFrame:
    """A file scan with each row's file and the start of its split."""
    return scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A unique id per row in file order (file path, then place in the file); not dense.

    ``df`` comes from ``_placed``. Splits are read in any order and several by one
    task, so a row's id is its split's rank with its number inside the task.
    """
    columns = [c for c in df.columns if c not in _SPLIT]
    ranks = df.select(*_SPLIT).distinct().select(*_SPLIT, F.row_number().over(Window.orderBy(*_SPLIT)).alias("_rank"))
    numbered = df.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per split, not per row of data.
    joined = numbered.join(F.broadcast(ranks), list(_SPLIT))
    return joined.select((F.shiftleft(F.col("_rank").cast("bigint") - 1, 33) + F.col("_at")).alias(name), *columns)


def read_table(spark: SparkSession, folder: str, name: str, key: str | None = None) -> DataFrame:
    """Parquet table ``folder/name.parquet``.

    A table in fewer pieces than there are cores (a small file) is spread by
    ``key``; a large one has more splits than cores and is read as it lies.
    """
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | list[str], row_id: str | None = "pair_id", multi_line: bool = True) -> DataFrame:
    """Quoted CSV with header; the named columns as text, multi-line fields kept, empty field as ''.

    A file with multi-line fields is read by one task, so keep such data in many
    files; ``multi_line=False`` splits large files whose fields have no line ends.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False)
    texts = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns]
    return _with_row_id(_placed(df).select(*texts, *_SPLIT), row_id) if row_id else df.select(*texts)


def read_pairs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, PAIR_COLUMNS, multi_line=multi_line)


def read_triples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, TRIPLE_COLUMNS, multi_line=multi_line)


def read_predictions(spark: SparkSession, path: str, direction: str) -> DataFrame:
    """(pair_id, source, ground_truth, output) of an unquoted TSV prediction file.

    Quotes and backslashes come through unchanged; a caption's leading ``[CLS] `` is dropped.
    """
    source = DIRECTIONS[direction][3]
    df = _placed(spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False))
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    output = without_leading_mark(text("output")) if direction == "smiles2caption" else text("output")
    return _with_row_id(
        df.select(text(source).alias("source"), text("ground truth").alias("ground_truth"), output.alias("output"), *_SPLIT),
        "pair_id",
    )


def flat_tree(df: DataFrame, json: Column | str, keep: list[str] | None = None) -> DataFrame:
    """(keep.., path, leaf) of JSON objects ``{group: [leaf | {group: [..]}]}`` of any depth.

    A group that is an object instead of a list has its keys as leaves. A leaf that is
    no string, a group that is neither list nor object, and a key twice in one group raise.
    Trees are walked inside their rows: one pass, whatever their depth.
    """
    found = df.select(*(keep or []), F.explode(tree_leaves(json)).alias("_leaf"))
    return found.select(*(keep or []), "_leaf.path", "_leaf.leaf")


def read_property_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, leaf) of a nested JSON property file."""
    return flat_tree(spark.read.text(path, wholetext=True), "value")


def read_combos(spark: SparkSession, path: str) -> DataFrame:
    """(combo_id, p1, p2): the printed pair in the first TAB field; parsed, never evaluated."""
    literal = r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""
    first = F.split_part(strip("value"), F.lit("\t"), F.lit(1))
    quoted = F.regexp_extract_all(first, F.lit(literal), F.lit(0))
    inner = F.transform(quoted, lambda q: F.regexp_replace(F.substr(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    lines = _placed(spark.read.text(path)).select(inner.alias("p"), *_SPLIT)
    return _with_row_id(lines.select(F.get("p", 0).alias("p1"), F.get("p", 1).alias("p2"), *_SPLIT), "combo_id")


def read_wide_vectors(spark: SparkSession, path: str, width: int = 300, key_index: int = 3) -> DataFrame:
    """(row_id, key, vec): the key column and the last ``width`` columns as one array."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in df.columns[-width:]])
    return _with_row_id(_placed(df).select(F.col(f"`{df.columns[key_index]}`").alias("key"), vec.alias("vec"), *_SPLIT), "row_id")


def read_vectors(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Parquet (id, vec) as doubles, with the split's name when given."""
    df = spark.read.parquet(path).select("id", F.col("vec").cast("array<double>"))
    return df if split is None else df.withColumn("split", F.lit(split))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, words) of a text file with one sentence per line."""
    return _with_row_id(_placed(spark.read.text(path)).select(spaced_words("value").alias("words"), *_SPLIT), "sent_id")


def record_kind(path: str) -> str:
    """'sdf', 'smi' or 'ism' from the extension, ``.gz`` allowed; anything else raises."""
    found = re.search(r"\.(sdf|smi|ism)(\.gz)?$", path.lower())
    if not found:
        raise ValueError("file extension not supported (sdf, smi, ism, each also with .gz)")
    return found.group(1)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, id, name) of a headerless tab-separated list, also gzipped."""
    if record_kind(path) == "sdf":
        raise ValueError("read_ids takes smi or ism files; use read_records for sdf")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
    return _with_row_id(_placed(spark.read.schema(schema).csv(path, sep="\t", quote="")), "row_id")


def read_records(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """(row_id, tags..) of ``> <TAG>`` records that end in ``$$$$``; a missing tag is NULL.

    A value may have several lines; the blank line after it ends it.
    """
    if record_kind(path) != "sdf":
        raise ValueError("read_records takes sdf files")
    records = _placed(spark.read.text(path, lineSep="$$$$\n")).where(strip("value") != "")

    def value(tag: str) -> Column:
        # The text after the tag's line, up to the first blank line: no pattern walks over the value.
        after = F.get(F.split("value", rf"(?m)^>[^\n]*<{re.escape(tag)}>[^\n]*\n", 2), 1)
        found = F.coalesce(F.regexp_replace(F.split_part(after, F.lit("\n\n"), F.lit(1)), r"\n\z", ""), F.lit(""))
        return F.when(F.contains("value", F.lit(f"<{tag}>")), found)

    return _with_row_id(records.select(*[value(t).alias(t) for t in tags], *_SPLIT), "row_id")


def read_public_split(spark: SparkSession, path: str, split: str | None, columns: dict[str, str]) -> DataFrame:
    """One split of a dataset stored as parquet: ``path/split``, columns selected and renamed."""
    where = os.path.join(path, split) if split else path
    return spark.read.parquet(where).select(*columns).withColumnsRenamed(columns)
