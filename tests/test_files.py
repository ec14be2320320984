import gzip
import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import prompts
from pairloom.functions import text as X
from pairloom.operators import pairs
from pairloom.sources import readers, writers


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv_with_quotes_lines_and_empties(spark, tmp_path):
    path = write(tmp_path / "t.csv", ',source,chosen,rejected\n0,"mol2cap: a ""q"" , b\nnext",,NA\n1,cap2mol: x,null,"C\\C"\n')
    rows = readers.read_triples(spark, path).collect()
    assert [(r.source, r.chosen, r.rejected) for r in rows] == [
        ('mol2cap: a "q" , b\nnext', "", "NA"), ("cap2mol: x", "null", "C\\C")]
    assert len({r.pair_id for r in rows}) == 2


@pytest.mark.parametrize("direction,source", [("smiles2caption", "SMILES"), ("caption2smiles", "description")])
def test_unquoted_predictions(spark, tmp_path, direction, source):
    path = write(tmp_path / "p.tsv", f'{source}\tground truth\toutput\nC/C=C\\C\ta "b\t[CLS] x"\n\tNA\t\n')
    rows = [(r.source, r.ground_truth, r.output) for r in readers.read_predictions(spark, path, direction).collect()]
    assert rows == [("C/C=C\\C", 'a "b', 'x"' if source == "SMILES" else '[CLS] x"'), ("", "NA", "")]


def test_prediction_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(' a "q', "t\tab\nline", ""), ("C\\C", " ", "x ")], "source string, ground_truth string, output string")
    path = str(tmp_path / "out")
    writers.write_predictions(df, path, "caption2smiles")
    rows = {(r.source, r.ground_truth, r.output) for r in readers.read_predictions(spark, path, "caption2smiles").collect()}
    assert rows == {(' a "q', "t ab line", ""), ("C\\C", " ", "x ")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(' a "q\nz', "", "C\\"), ("b", "x,y", "\t")], "source string, chosen string, rejected string")
    writers.write_csv(df, str(tmp_path / "c"))
    rows = {(r.source, r.chosen, r.rejected) for r in readers.read_triples(spark, str(tmp_path / "c")).collect()}
    assert rows == {(' a "q\nz', "", "C\\"), ("b", "x,y", "\t")}


def test_property_tree_and_combos(spark, tmp_path):
    tree = write(tmp_path / "t.json", json.dumps({"A b": ["x", {"s": ["Y"]}], "c": ["x"]}, indent=1))
    rows = {(r.path, r.leaf) for r in readers.read_property_tree(spark, tree).collect()}
    assert rows == {("A b__x", "x"), ("A b__s__Y", "Y"), ("c__x", "x")}
    combos = write(tmp_path / "c.txt", "('a__x', 'b__y')\t3\n(\"it's\", 'q\\'s')\trest\n")
    assert [(r.p1, r.p2) for r in readers.read_combos(spark, combos).collect()] == [("a__x", "b__y"), ("it's", "q's")]


def test_wide_vectors(spark, tmp_path):
    path = write(tmp_path / "v.csv", "i,ID,x,key,v0,v1\n0,a,,CCO,1,2.5\n1,b,,CC,3,-4e-1\n")
    assert [(r.key, r.vec) for r in readers.read_wide_vectors(spark, path, 2).collect()] == [("CCO", [1.0, 2.5]), ("CC", [3.0, -0.4])]


def test_corpus_ids_and_records(spark, tmp_path):
    assert [r.words for r in readers.read_corpus(spark, write(tmp_path / "c", " a  b\tc \n\nd\n")).collect()] == [["a", "b", "c"], [], ["d"]]
    with gzip.open(tmp_path / "m.smi.gz", "wt") as f:
        f.write("CCO\tone\nC\\C\n")
    assert [(r.id, r.name) for r in readers.read_ids(spark, str(tmp_path / "m.smi.gz")).collect()] == [("CCO", "one"), ("C\\C", None)]
    sdf = write(tmp_path / "r.sdf", "head\nM  END\n>  <GT_SMI>\nCCO\n\n> <ID> (1)\n7\n\n$$$$\nx\n>  <GT_SMI>\nCC\n\n$$$$\n")
    assert [(r.GT_SMI, r.ID) for r in readers.read_records(spark, sdf, ["GT_SMI", "ID"]).collect()] == [("CCO", "7"), ("CC", None)]
    for bad in ("x.csv", "x.gz", "x.csv.gz"):
        with pytest.raises(ValueError):
            readers.record_kind(bad)
    assert readers.record_kind("a/b.SDF.gz") == "sdf"


def test_public_split(spark, tmp_path):
    spark.createDataFrame([("C", "d", 1)], "SMILES string, description string, x int").write.parquet(str(tmp_path / "d/test"))
    got = readers.read_public_split(spark, str(tmp_path / "d"), "test", {"SMILES": "molecule", "description": "caption"})
    assert got.columns == ["molecule", "caption"] and got.count() == 1


def test_vectors_and_report(spark, tmp_path):
    spark.createDataFrame([(1, [1.0])], "id long, vec array<float>").write.parquet(str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v"), "train").first().asDict() == {"id": 1, "vec": [1.0], "split": "train"}
    writers.write_report(spark.createDataFrame([("f1", "", 0.5)], "metric string, path string, value double"), str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().value == "0.5"


def test_column_functions_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("mol2cap: CCO", "['x#\\n']")], "source string, output string").write.parquet(source)
    stream = spark.readStream.schema("source string, output string").parquet(source)
    rows = stream.select(X.task_of("source").alias("task"), prompts.prompt_of_marked("source").alias("prompt"), X.cleaned("output").alias("output"))
    run = rows.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = spark.table("cleaned").first()
    assert got.task == "mol2cap" and got.output == "x#" and "CCO" in got.prompt


def test_pairs_file(spark, tmp_path):
    path = write(tmp_path / "p.csv", "molecule,caption,extra\nCCO,alcohol,1\n")
    row = pairs.directed(readers.read_pairs(spark, path), "caption2smiles").first()
    assert (row.source, row.target) == ("alcohol", "CCO")
    assert readers.read_csv(spark, path, ("caption",), None).columns == ["caption"]
    assert readers.read_pairs(spark, path).select(F.count("*")).first()[0] == 1


def test_records_keep_whole_values(spark, tmp_path):
    path = str(tmp_path / "r.sdf")
    rows = [("k1", "line1\nline2"), ("k2", ""), ("k3", "a\nb\nc"), ("k4", None)]
    writers.write_records(spark.createDataFrame(rows, "key string, note string").coalesce(1), ["key", "note"], path)
    got = readers.read_records(spark, path, ["key", "note"]).orderBy("row_id").collect()
    assert [(r.key, r.note or "") for r in got] == [(k, v or "") for k, v in rows]
    for bad in ("a\n\nb", "\na", "a\n", "x\n>  <key>", "a$$$$\nb"):
        with pytest.raises(Exception, match="does not fit"):
            writers.write_records(spark.createDataFrame([("k", bad)], "key string, note string"), ["key", "note"], str(tmp_path / str(hash(bad))))


def test_lines_stay_lines(spark, tmp_path):
    path = str(tmp_path / "l")
    writers.write_lines(spark.createDataFrame([("a\nb", "c\td", None)], "x string, `y.z` string, w string"), ["x", "y.z", "w"], path)
    assert [r.value for r in spark.read.text(path).collect()] == ["a b\tc d\t"]


def test_row_ids_follow_the_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for part, n in ((0, 3), (1, 4000), (2, 50)):
        (tmp_path / "c" / f"part-{part}.txt").write_text("".join(f"w{part} n{i}\n" for i in range(n)))
    got = [r.words for r in readers.read_corpus(spark, str(tmp_path / "c")).orderBy("sent_id").collect()]
    assert got == [[f"w{part}", f"n{i}"] for part, n in ((0, 3), (1, 4000), (2, 50)) for i in range(n)]
