"""Plans that must keep their shape, and row-wise work on a stream."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shotweave.functions.parsing import parse_yes_no
from shotweave.functions.prompts import classification_prompt
from shotweave.operators.cleaning import dedup_keep_first, with_canonical_key

SF = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize(
    "name",
    ["group_split", "knn_train", "candidate_pool", "shots_random_global", "records_classification",
     "records_regression", "roc_auc", "pad_batches", "oversample_minority"],
)
def test_no_pairs_and_no_nested_loops(spark, name):
    shown = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_only_needed_columns_are_read(spark):
    shown = plan(contract.queries()["word_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown or "ReadSchema: struct<text:string>" in shown
    shown = plan(contract.queries()["int_label"](spark, SF))
    assert "p_name" not in shown.split("ReadSchema")[1].split("\n")[0]


def test_copies_are_reduced_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    shown = plan(dedup_keep_first(with_canonical_key(df, "text")))
    assert "partial_min_by" in shown and shown.count("Exchange") >= 1


def test_row_wise_work_runs_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("t1", " Yes"), ("t2", "no")], "text string, answer string").write.json(str(source))
    stream = spark.readStream.schema("text string, answer string").json(str(source))
    judged = stream.select(
        parse_yes_no(F.col("answer")).alias("label"), classification_prompt(F.col("text"), "do X").alias("prompt")
    )
    query = (
        judged.writeStream.format("memory").queryName("judged").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.awaitTermination(60)
    rows = spark.sql("SELECT * FROM judged ORDER BY label").collect()
    assert [r["label"] for r in rows] == [0, 1] and rows[1]["prompt"].endswith("SMILES: t1\nLabel:")
