"""Instruction, preference, binary-feedback and chat tables from text pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.functions import prompts
from pairloom.functions.text import CAP2MOL, MOL2CAP, task_of
from pairloom.operators.digests import distinct_rows, without_texts

# Direction -> (source column, target column, marker, source header of a prediction file).
DIRECTIONS = {
    "smiles2caption": ("molecule", "caption", MOL2CAP, "SMILES"),
    "caption2smiles": ("caption", "molecule", CAP2MOL, "description"),
}

# Bytes of a caller's batch; Spark's own batches have so many rows, however long.
BATCH_BYTES = 4 << 20


def directed(pairs: DataFrame, direction: str) -> DataFrame:
    """(pair_id, source, target) of molecule / caption pairs in one direction."""
    source, target, _, _ = DIRECTIONS[direction]
    return pairs.select("pair_id", F.col(source).alias("source"), F.col(target).alias("target"))


def preference_triples(pairs: DataFrame, predictions: DataFrame, direction: str) -> DataFrame:
    """(pair_id, source, chosen, rejected): the marked source, the true target, the model's text.

    ``predictions``: (pair_id, predicted), one row per pair.
    """
    marker = DIRECTIONS[direction][2]
    return directed(pairs, direction).join(predictions, "pair_id").select(
        "pair_id",
        F.concat(F.lit(marker + " "), "source").alias("source"),
        F.col("target").alias("chosen"),
        F.col("predicted").alias("rejected"),
    )


def triples_by_direction(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """The triples of all directions from one join.

    ``predictions``: (pair_id, direction, predicted), one row per pair and direction; without
    ``direction`` a prediction stands for every direction, and its text is moved once.
    """
    def pick(at: int) -> Column:
        values = [F.lit(d[at] + " ") if at == 2 else F.col(d[at]) for d in DIRECTIONS.values()]
        return prompts.by_task("direction", dict(zip(DIRECTIONS, values)))

    joined = pairs.join(predictions, "pair_id")
    if "direction" not in predictions.columns:
        joined = joined.withColumn("direction", F.explode(F.array(*map(F.lit, DIRECTIONS))))
    return joined.select(
        "pair_id", F.concat(pick(2), pick(0)).alias("source"), pick(1).alias("chosen"), F.col("predicted").alias("rejected"))


def both_directions(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def rejects(triples: DataFrame, source: str = "source") -> DataFrame:
    """Rows without a task marker; every prompt builder leaves exactly these out."""
    return triples.where(task_of(source).isNull())


def _marked(triples: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return triples.where(task_of("source").isNotNull())
    checked = F.when(task_of("source").isNotNull(), F.col("source")).otherwise(
        F.raise_error(F.lit("source without a task marker"))
    )
    return triples.withColumn("source", checked)


def ranking_prompts(triples: DataFrame, end_mark: str = "</s>", strict: bool = False) -> DataFrame:
    """(pair_id, prompt, chosen, rejected) with the end mark on both completions."""
    return _marked(triples, strict).select(
        "pair_id",
        prompts.prompt_of_marked("source").alias("prompt"),
        prompts.with_end("chosen", end_mark).alias("chosen"),
        prompts.with_end("rejected", end_mark).alias("rejected"),
    )


def unpivoted(triples: DataFrame) -> DataFrame:
    """(pair_id, prompt, completion, label): one row per completion, label true for the chosen one."""
    rows = triples.unpivot(["pair_id", "source"], ["chosen", "rejected"], "kind", "completion")
    return rows.select("pair_id", F.col("source").alias("prompt"), "completion", (F.col("kind") == "chosen").alias("label"))


def feedback_chats(triples: DataFrame, strict: bool = False) -> DataFrame:
    """Binary-feedback table whose prompt and completion are one-message chats."""
    rows = unpivoted(_marked(triples, strict))
    return rows.select(
        "pair_id",
        prompts.chat(prompts.message("user", prompts.prompt_of_marked("prompt"))).alias("prompt"),
        prompts.chat(prompts.message("assistant", "completion")).alias("completion"),
        "label",
    )


def feedback_texts(triples: DataFrame, strict: bool = False) -> DataFrame:
    """The same with both chats rendered to text."""
    return feedback_chats(triples, strict).withColumns({
        "prompt": prompts.chat_text("prompt"), "completion": prompts.chat_text("completion"),
    })


def instructions(triples: DataFrame, strict: bool = False) -> DataFrame:
    """(pair_id, instruction, input, output)."""
    parts = prompts.instruction_parts("source", "chosen")
    return _marked(triples, strict).select("pair_id", parts.alias("_p")).select("pair_id", "_p.*")


def instruction_texts(triples: DataFrame, strict: bool = False) -> DataFrame:
    return instructions(triples, strict).select(
        "pair_id", prompts.instruction_text("instruction", "input", "output").alias("text")
    )


def ranked_texts(triples: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), each the source followed by the completion."""
    return triples.select(
        "pair_id", F.concat("source", "chosen").alias("chosen"), F.concat("source", "rejected").alias("rejected")
    )


def inference_prompts(pairs: DataFrame, direction: str, style: str = "instruction") -> DataFrame:
    """(pair_id, source, prompt, ground_truth); ``style``: 'instruction' or 'prefix'.

    The raw source stays in its own column; only ``prompt`` carries the added words.
    """
    task = F.lit("mol2cap" if direction == "smiles2caption" else "cap2mol")
    if style == "instruction":
        prompt = prompts.rendered_by_task(prompts.INFERENCE, task, "source")
    elif style == "prefix":
        prompt = prompts.prefixed(task, "source")
    else:
        raise ValueError("style must be 'instruction' or 'prefix'")
    return directed(pairs, direction).select(
        "pair_id", "source", prompt.alias("prompt"), F.col("target").alias("ground_truth")
    )


def task_union(pairs: DataFrame) -> DataFrame:
    """(pair_id, instruction, input, output): each pair once per task, from one scan."""
    def entry(task: str, source: str, target: str) -> Column:
        return F.struct(
            F.lit(prompts.TASK_INSTRUCTION[task]).alias("instruction"),
            F.col(source).alias("input"),
            F.col(target).alias("output"),
        )

    both = F.array(entry("mol2cap", "molecule", "caption"), entry("cap2mol", "caption", "molecule"))
    return pairs.select("pair_id", F.explode(both).alias("_e")).select("pair_id", "_e.*")


def task_chats(pairs: DataFrame) -> DataFrame:
    """(pair_id, prompt, reference): system and user message, opened for the assistant."""
    messages = prompts.chat(
        prompts.message("system", F.lit(prompts.SYSTEM_MESSAGE)),
        prompts.message("user", F.concat("instruction", "input")),
    )
    return task_union(pairs).select(
        "pair_id", prompts.chat_text(messages, generation_prompt=True).alias("prompt"), F.col("output").alias("reference")
    )


def length_percentile(length: Column, percent: float = 100, approximate: bool = False) -> Column:
    """Percentile of a length, interpolated between neighbours and cut to an integer.

    Exact by default: the aggregate's state has one entry per distinct length.
    """
    function = F.percentile_approx if approximate else F.percentile
    return function(length, F.lit(percent / 100)).cast("bigint")


def pair_lengths(prompted: DataFrame, size: Callable[[Column], Column], percent: float = 100) -> DataFrame:
    """One row (prompt_length, chosen_length, rejected_length, max_length); ``size`` counts a text's tokens."""
    measured = prompted.select(
        size(F.col("prompt")).alias("p"),
        size(F.concat("prompt", "chosen")).alias("c"),
        size(F.concat("prompt", "rejected")).alias("r"),
    )
    one = measured.agg(
        length_percentile(F.col("p"), percent).alias("prompt_length"),
        length_percentile(F.col("c"), percent).alias("chosen_length"),
        length_percentile(F.col("r"), percent).alias("rejected_length"),
    )
    return one.withColumn("max_length", F.greatest("chosen_length", "rejected_length"))


def longest_of_splits(*lengths: DataFrame) -> DataFrame:
    """Largest prompt and sequence length over several splits' one-row results."""
    every = lengths[0]
    for more in lengths[1:]:
        every = every.unionByName(more)
    return every.agg(F.max("prompt_length").alias("prompt_length"), F.max("max_length").alias("max_length"))


def first_per_key(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key text with the value of its first row; ``order`` is a row id (distinct, not null)."""
    return distinct_rows(pairs.select(key, value, order), [key], order).select(key, value)


def excluding(rows: DataFrame, seen: DataFrame, key: str, row_id: list[str]) -> DataFrame:
    """Rows whose key text does not occur in ``seen``; ``row_id`` tells the rows apart."""
    return without_texts(rows, seen, key, row_id)


def _plain(schema: T.StructType) -> bool:
    """Whether pandas shows every column as Arrow holds it: no times, decimals, bytes or nested values."""
    return all(isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)) for f in schema.fields)


def score_batches(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the caller's batch function over all rows, partition by partition.

    Of plain columns it gets about ``max_bytes`` at a time, however long the texts are.
    """
    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, batch.num_rows * max_bytes // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_pandas(predict(part.to_pandas()), schema=out, preserve_index=False)

    kinds = T.StructType.fromDDL(schema)
    if not (_plain(kinds) and _plain(df.schema)):
        return df.mapInPandas(run, schema)
    out = to_arrow_schema(kinds)
    return df.mapInArrow(run_parts, schema)


def prediction_table(prompted: DataFrame, outputs: DataFrame) -> DataFrame:
    """(pair_id, source, ground_truth, output) of prompts and (pair_id, output) model texts."""
    return prompted.join(outputs, "pair_id").select("pair_id", "source", "ground_truth", "output")
