import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from shotweave.functions.prompts import (
    CLASSIFICATION, CLASSIFICATION_SCORING, REGRESSION, classification_prompt, no_shots, regression_prompt,
)
from shotweave.functions.text import format_label, retrieval_text
from shotweave.operators.merge import merge_shuffle
from shotweave.operators.sft import pad_batches, sft_concat, sft_padded
from shotweave.plans.records import (
    RecordConfig, build_classification, build_regression, prepare_classification, value_range,
)
from shotweave.sources.records import (
    RECORD_SCHEMA, read_record_lines, read_records, write_metrics, write_record_lists, write_records,
)
from shotweave.sources.tables import MISSING_WORDS, read_corpus, read_task

RECORD = {"instruction": "i", "input": "x", "output": "o", "original_text": "t"}


def test_record_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([RECORD, {"instruction": "second"}], indent=2))
    (tmp_path / "object.json").write_text(json.dumps(RECORD))
    (tmp_path / "broken.json").write_text(json.dumps([RECORD])[:-5])
    with pytest.warns(UserWarning, match="no files found"):
        records, skipped = read_records(
            spark, [f"{tmp_path}/*.json", f"{tmp_path}/good.json", f"{tmp_path}/none*.json"]
        )
    assert [r["instruction"] for r in records.orderBy("instruction").collect()] == ["i", "i", "second", "second"]
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in skipped.collect()}
    assert reasons == {"object.json": "not a list", "broken.json": "malformed"}


def test_strict_reading_fails(spark, tmp_path):
    (tmp_path / "object.json").write_text(json.dumps(RECORD))
    with pytest.raises(FileNotFoundError):
        read_records(spark, [f"{tmp_path}/none.json"], on_bad="fail")
    with pytest.raises(Exception, match="not a JSON list"):
        read_records(spark, [f"{tmp_path}/object.json"], on_bad="fail")


def test_bad_elements_cost_nothing_else(spark, tmp_path):
    mixed = '[{"instruction": "a", "original_smiles": "C", "x": 1, "y": {"z": [2]}}, "str", {"instruction": "z", "output": NaN}, null]'
    (tmp_path / "1.json").write_text(mixed)
    (tmp_path / "2.json").write_text("[] trailing")
    (tmp_path / "3.json").write_text(json.dumps([RECORD]))
    (tmp_path / "4.json").write_text("[]")
    records, skipped = read_records(spark, [f"{tmp_path}/*.json"])
    rows = records.orderBy("row_id").collect()
    assert [(r["row_id"], r["instruction"], r["original_text"]) for r in rows] == [(0, "a", "C"), (2, "z", None), (4, "i", "t")]
    assert rows[0]["other"] == {"x": "1", "y": '{"z":[2]}'} and rows[1]["other"] is None
    faults = sorted((r["path"].rsplit("/", 1)[1], r["position"], r["reason"]) for r in skipped.collect())
    assert faults == [("1.json", 1, "not an object"), ("1.json", 3, "not an object"), ("2.json", -1, "malformed")]
    merged = merge_shuffle([records, records]).collect()
    assert len(merged) == 6 and {"position_hash", "other"} <= set(merged[0].asDict())


def test_lines_keep_their_number_and_all_fields(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"row_id": 7, "instruction": "i", "more": 3}\n\n{"original_smiles": "C"}\n')
    first, second = read_record_lines(spark, str(tmp_path)).orderBy("row_id").collect()
    assert (first["row_id"], first["other"]) == (7, {"more": "3"}) and second["original_text"] == "C" and second["row_id"] > 7


def test_records_are_written_per_task_and_split(spark, tmp_path):
    rows = [("a", "train", "i1"), ("a", "test", "i2"), ("b", "train", "i3")]
    df = spark.createDataFrame(rows, "task string, split string, instruction string")
    write_records(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "task=b").iterdir()) == ["split=train"]
    back = read_record_lines(spark, str(tmp_path / "out" / "task=a" / "split=test"), RECORD_SCHEMA)
    assert [r["instruction"] for r in back.collect()] == ["i2"]
    metrics = spark.createDataFrame([("a", "s", "ACC", 1.0)], "task string, strategy string, metric string, value double")
    write_metrics(metrics, str(tmp_path / "res"))
    assert (tmp_path / "res_metrics" / "task=a" / "strategy=s").is_dir()


def test_a_task_written_again_replaces_its_folders_only(spark, tmp_path):
    schema, out = "task string, split string, instruction string", tmp_path / "out"
    write_records(spark.createDataFrame([("a", "train", "1"), ("a", "test", "2"), ("b/ü", "train", "3"), (None, "x", "4")], schema), str(out))
    other = {p: p.read_bytes() for p in out.rglob("*.json") if "task=a" not in str(p)}
    write_records(spark.createDataFrame([("a", "train", "5")], schema), str(out))
    assert [p.name for p in (out / "task=a").iterdir()] == ["split=train"]
    assert {p: p.read_bytes() for p in out.rglob("*.json") if "task=a" not in str(p)} == other and len(other) == 2
    found = {(r["task"], r["instruction"]) for r in spark.read.schema(schema).json(str(out)).collect()}
    assert found == {("a", "5"), ("b/ü", "3"), (None, "4")}
    assert not [p for p in out.iterdir() if p.name.startswith("_staged")]
    write_records(spark.createDataFrame([], schema), str(out))
    assert spark.read.schema(schema).json(str(out)).count() == 3


def test_metrics_can_be_written_again(spark, tmp_path):
    for value in (0.5, 0.75):
        df = spark.createDataFrame([("a", "s", "ACC", value)], "task string, strategy string, metric string, value double")
        write_metrics(df, str(tmp_path / "res"))
    assert [r["value"] for r in spark.read.json(str(tmp_path / "res_metrics")).collect()] == [0.75]


@pytest.mark.parametrize("multiline", [True, False])
def test_task_table(spark, tmp_path, multiline):
    lines = ["smiles,label,other"] + [f'"C,{i}",{i % 2},{w}' for i, w in enumerate(MISSING_WORDS)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows = read_task(spark, str(tmp_path / "t.csv"), "smiles", "label", multiline=multiline).orderBy("row_id").collect()
    assert [r["smiles"] for r in rows] == [f"C,{i}" for i in range(len(MISSING_WORDS))]
    assert [r["row_id"] for r in rows] == list(range(len(MISSING_WORDS)))
    assert all(r["other"] is None for r in rows)
    with pytest.raises(ValueError, match="not found"):
        read_task(spark, str(tmp_path / "t.csv"), "nope", "label")


def test_ordinals_follow_files_and_positions(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for part, start in (("a", 0), ("b", 500), ("c", 520)):
            end = {"a": 500, "b": 520, "c": 1000}[part]
            body = "".join(f"text {i},{i}\n" for i in range(start, end))
            (tmp_path / f"{part}.csv").write_text("text,label\n" + body)
        rows = read_task(spark, str(tmp_path), "text", "label", multiline=False).collect()
        assert len(rows) == 1000 and all(int(r["label"]) == r["row_id"] for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corpus_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="neither"):
        read_corpus(spark, str(tmp_path), "text")
    spark.createDataFrame([("x",), (None,)], "text string").write.parquet(str(tmp_path / "c"))
    assert [r[0] for r in read_corpus(spark, str(tmp_path / "c"), "text").collect()] == ["x"]
    with pytest.raises(ValueError, match="available"):
        read_corpus(spark, str(tmp_path / "c"), "other")


def test_prompt_layout(spark):
    df = spark.range(1).select(
        classification_prompt(F.lit("C[MASK]"), "do X", no_shots()).alias("zero"),
        classification_prompt(
            F.lit("C[MASK]"), "do X", F.expr("array(named_struct('text', 'CC', 'label', 'Yes'))"), CLASSIFICATION_SCORING
        ).alias("few"),
        regression_prompt(F.lit("C"), "do Y", F.lit(-1.5), F.lit(2000.0), None, REGRESSION).alias("number"),
    ).first()
    assert df["zero"] == (
        "You are an expert molecule classifier. Your task is to do X.\n"
        "Your output MUST be exactly 'Yes' or 'No'. Do NOT include any additional text, explanations, or "
        "examples after your answer.\n\nAnalyze the following molecule's structure. Note that a key part of the "
        "molecule has been masked and is represented by '[MASK]'.\n\nSMILES: C[MASK]\nLabel:"
    )
    assert df["few"].endswith(
        "Here are some examples based on the provided molecules:\nSMILES: CC\nLabel: Yes\n\n"
        "Now, based on these examples, classify the following molecule:\nSMILES: C[MASK]\nLabel:"
    )
    assert "typically between -1.50 and 2000.00. Your output" in df["number"]
    assert df["number"].endswith("SMILES: C\nPredicted Value:")


def test_texts_and_labels(spark):
    row = spark.range(1).select(
        format_label(F.lit(1234567.5)).alias("f"), retrieval_text(F.lit(""), F.lit("m"), "or").alias("o"),
        retrieval_text(F.lit(""), F.lit("m"), "default").alias("d"),
    ).first()
    assert tuple(row) == ("1234567.5000", "m", "")
    assert tuple(value_range(spark.createDataFrame([], "v double"), "v").first()) == (0.0, 0.0)


def task(spark, n=40):
    rows = [(i, f"word{i} common{i % 4} text{i % 7}", str(i % 2), f"g{i % 8}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, text string, label string, g string")


def test_classification_build(spark):
    split = prepare_classification(task(spark), "text", "label", "g")
    rows = build_classification(split, RecordConfig("t", "do X", shots=2)).collect()
    assert len(rows) == 40 and {r["split"] for r in rows} == {"train", "validation", "test"}
    texts = {r["original_text"]: r["output"] for r in rows}
    for r in rows:
        assert r["instruction"].count("SMILES: ") == 3 and r["input"].count("[MASK]") == 1
        assert r["output"] == ("Yes" if r["row_id"] % 2 else "No") == texts[r["original_text"]]
    with pytest.warns(UserWarning, match="task skipped"):
        assert prepare_classification(task(spark, 12), "text", "label", "g") is None


def test_regression_build_drops_rows_short_of_examples(spark):
    rows = [(1, "a b c", "1.5"), (2, "a b d", "x"), (3, "a e f", "2.25"), (4, " ", "3")]
    df = spark.createDataFrame(rows, "row_id long, text string, label string")
    one = build_regression(df, RecordConfig("t", "do Y", shots=1)).orderBy("row_id").collect()
    assert [(r["row_id"], r["output"]) for r in one] == [(1, "1.5000"), (3, "2.2500")]
    assert "SMILES: a e f\nPredicted Value: 2.2500" in one[0]["instruction"]
    assert "between 1.50 and 3.00" in one[0]["instruction"]
    assert build_regression(df, RecordConfig("t", "do Y", shots=2)).count() == 0
    assert build_regression(df, RecordConfig("t", "do Y")).count() == 3


def test_merging_keeps_duplicates(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "row_id long, input string")
    b = a.withColumn("extra", F.lit("e"))
    merged = merge_shuffle([a, b]).collect()
    assert len(merged) == 100 and [r["row_id"] for r in merged] != list(range(50)) * 2
    assert [r["position_hash"] for r in merged] == sorted(r["position_hash"] for r in merged)


def letters(text):
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def test_concat_arrays_cut_the_target(spark):
    df = spark.createDataFrame([(" abc ", "de", "xyz"), ("abcdefgh", "ij", "xyz")], "instruction string, input string, output string")
    first, second = sft_concat(df, letters, 8).collect()
    assert first["input_ids"] == [97, 98, 99, 10, 100, 101, 120]
    assert first["labels"] == [-100] * 6 + [120]
    assert second["labels"] == [-100] * 8 and len(second["input_ids"]) == 8


def test_padded_arrays(spark):
    df = spark.createDataFrame([("a", "b", "xy")], "instruction string, input string, output string")
    prompt = "Instruction:\na\n\nInput:\nb\n\nOutput:\n"
    n = len(prompt)
    row = sft_padded(df, letters, 1, "$", n + 5).first()
    assert row["input_ids"] == [ord(c) for c in prompt + "xy$"] + [1, 1]
    assert row["attention_mask"] == [1] * (n + 3) + [0, 0]
    assert row["labels"] == [-100] * n + [ord("x"), ord("y"), ord("$"), 1, 1]
    cut = sft_padded(df, letters, 1, "$", 10).first()
    assert cut["labels"] == [-100] * 10 and cut["attention_mask"] == [1] * 10


@pytest.mark.parametrize("label_pad, expected", [(None, 0), (-100, -100)])
def test_batches_are_padded_to_their_longest(spark, label_pad, expected):
    rows = [(i, [7] * n, [8] * n) for i, n in enumerate([1, 3, 2, 5])]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>, labels array<int>")
    padded = pad_batches(df, 2, 0, label_pad=label_pad).orderBy("row_id").collect()
    assert [r["batch_id"] for r in padded] == [0, 0, 1, 1]
    assert padded[0]["input_ids"] == [7, 0, 0] and padded[2]["labels"] == [8, 8] + [expected] * 3


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9])
def test_record_lists_are_in_order_and_whole(spark, tmp_path, n):
    path = str(tmp_path / "lists")
    df = spark.createDataFrame([(n - i, None if i == 2 else f"a\n\"{i}") for i in range(n)], "row_id long, text string")
    write_record_lists(df.repartition(3), path, "row_id", [F.col("text").alias("input"), F.col("text").alias("original_text")], 4)
    files = sorted((tmp_path / "lists").glob("part-*"))
    lists = [json.loads(f.read_text()) for f in files if f.stat().st_size]
    assert all(1 <= len(found) <= 4 for found in lists)
    expected = [None if i == 2 else f"a\n\"{i}" for i in reversed(range(n))]
    assert [r.get("original_text") for found in lists for r in found] == expected
    if n:
        records = read_records(spark, [f"{path}/part-*"], on_bad="fail")[0].orderBy("row_id").collect()
        assert [(r["row_id"], r["input"]) for r in records] == list(enumerate(expected))


def test_texts_of_record_lists_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Numbered and then grouped, they were moved twice, and a text in two fields twice again."""
    shuffled = []
    by_range = DataFrame.repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda df, *c: shuffled.append(df.columns) or by_range(df, *c))
    df = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("text"))
    write_record_lists(df, str(tmp_path / "lists"), "row_id", [F.col("text").alias("a"), F.col("text").alias("b")])
    assert shuffled == [["row_id", "text"]]
