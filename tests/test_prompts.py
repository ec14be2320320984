import pytest
from pyspark.sql import functions as F

from pairloom.functions import prompts
from pairloom.operators import pairs


@pytest.fixture
def triples(spark):
    return spark.createDataFrame(
        [(1, "mol2cap: CCO ", "good", "bad"), (2, "cap2mol: a {source} text", "CC", "C"), (3, "none", "x", "y")],
        "pair_id long, source string, chosen string, rejected string")


def test_ranking_prompts(triples):
    rows = {r.pair_id: r for r in pairs.ranking_prompts(triples).collect()}
    assert set(rows) == {1, 2}
    assert "Molecule: CCO\n" in rows[1].prompt and rows[1].prompt.endswith("### Response:")
    assert "Caption: a {source} text\n" in rows[2].prompt
    assert (rows[1].chosen, rows[1].rejected) == ("good</s>", "bad</s>")
    assert [r.pair_id for r in pairs.rejects(triples).collect()] == [3]
    with pytest.raises(Exception, match="without a task marker"):
        pairs.ranking_prompts(triples, strict=True).collect()


def test_unpivot_doubles_rows(triples):
    rows = pairs.unpivoted(triples).collect()
    assert len(rows) == 6
    assert sorted((r.pair_id, r.completion) for r in rows if r.label) == [(1, "good"), (2, "CC"), (3, "x")]


def test_feedback_chats(triples):
    row = pairs.feedback_chats(triples).where("pair_id = 1 and label").first()
    assert row.prompt[0].role == "user" and row.completion[0].asDict() == {"role": "assistant", "content": "good"}
    text = pairs.feedback_texts(triples).where("pair_id = 1 and label").first()
    assert text.completion == "<|im_start|>assistant\ngood<|im_end|>\n"


def test_instruction_text(triples):
    row = pairs.instructions(triples).where("pair_id = 2").first()
    assert row.output == "CC" and row.input.startswith("Caption: a")
    text = pairs.instruction_texts(triples).where("pair_id = 2").first().text
    assert text == text.strip() and text.endswith("### Response:\nCC")


def test_task_union_and_chat(spark):
    p = spark.createDataFrame([(1, "CCO", "alcohol")], "pair_id long, molecule string, caption string")
    rows = pairs.task_union(p).collect()
    assert {(r.input, r.output) for r in rows} == {("CCO", "alcohol"), ("alcohol", "CCO")}
    chats = [r.prompt for r in pairs.task_chats(p).collect()]
    assert all(c.endswith("<|im_start|>assistant\n") and c.count("<|im_start|>") == 3 for c in chats)
    for style, start in (("prefix", "Translate the"), ("instruction", "Below is")):
        row = pairs.inference_prompts(p, "smiles2caption", style).first()
        assert row.source == "CCO" and row.ground_truth == "alcohol" and row.prompt.startswith(start)


def test_triples_and_predictions(spark):
    p = spark.createDataFrame([(1, "CCO", "alcohol")], "pair_id long, molecule string, caption string")
    got = spark.createDataFrame([(1, "ether")], "pair_id long, predicted string")
    row = pairs.preference_triples(p, got, "smiles2caption").first()
    assert (row.source, row.chosen, row.rejected) == ("mol2cap: CCO", "alcohol", "ether")
    scored = pairs.score_batches(
        pairs.inference_prompts(p, "caption2smiles").select("pair_id", "prompt"),
        lambda b: b[["pair_id"]].assign(output=b["prompt"].str.len().astype(str)), "pair_id long, output string")
    full = pairs.prediction_table(pairs.inference_prompts(p, "caption2smiles"), scored).first()
    assert full.source == "alcohol" and int(full.output) > 100


def test_length_percentiles(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 10)], "n int")
    got = df.agg(*[pairs.length_percentile(F.col("n"), p) for p in (100, 95, 50)]).first()
    assert tuple(got) == (10, 8, 2)
    lengths = [spark.createDataFrame([(a, b)], "prompt_length long, max_length long") for a, b in ((1, 9), (4, 3))]
    assert tuple(pairs.longest_of_splits(*lengths).first()) == (4, 9)


def test_first_per_key(spark):
    df = spark.createDataFrame([(2, "m", "b"), (1, "m", "a"), (3, "n", "c")], "pair_id long, molecule string, caption string")
    assert sorted(map(tuple, pairs.first_per_key(df, "molecule", "caption", "pair_id").collect())) == [("m", "a"), ("n", "c")]


def test_render_keeps_source_verbatim(one):
    assert one(prompts.render("<{source}>", "c"), c="$1 \\ {source}") == "<$1 \\ {source}>"
