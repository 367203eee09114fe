"""Masking, prompts, records, merging and fine-tuning arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    CONVERSATIONS, PARTS, Query, TASK_TEXT, conversation_records, documents, fp, h, ids, labelled,
    parts, quote, strip, table, word_ids, word_mask,
)
from catalog.cleaning import ORACLES as CLEANING
from catalog.models import stub_model
from catalog.similarity import FP, PART_NEAR, neighbours
from shotweave.functions.prompts import (
    CLASSIFICATION, CLASSIFICATION_SCORING, CLASSIFICATION_TAGGED, REGRESSION,
    REGRESSION_SCORING, SHOTS_TYPE, Wording, classification_prompt, no_shots, regression_prompt,
)
from shotweave.functions.text import lossless_words
from shotweave.operators.masking import mask_token
from shotweave.operators.merge import merge_shuffle
from shotweave.operators.bpe import bpe_ids, bpe_train, word_counts
from shotweave.operators.sft import pad_batches, sft_concat, sft_padded
from shotweave.plans.records import (
    RecordConfig, build_classification, build_classification_tasks, build_regression,
    build_regression_tasks, prepare_classification, prepare_classification_tasks, value_range,
)
from shotweave.plans.scoring import (
    CLASSIFY, CLASSIFY_STRATEGIES, REGRESS, REGRESS_STRATEGIES, score, scoring_prompts,
)
from shotweave.sources.records import read_records, write_record_lists
from shotweave.storage import materialise, scratch_path

# Default lengths of the two forms of fine-tuning arrays.
CONCAT_LENGTH, PADDED_LENGTH = 1024, 512

PRICE_TEXT = "predict the retail price"
SPLIT_TASKS = CLEANING["split_tasks"]


def masked_words(spark, sf):
    d = documents(spark, sf).withColumn("tokens", lossless_words(F.col("text")))
    return mask_token(d, "text", "tokens", "row_id").select("row_id", "masked", "mask_tag")


def label_range(spark, sf):
    return value_range(parts(spark, sf), "label")


def _two_shots(text, label):
    one = F.struct(F.lit("first").alias("text"), F.lit("Yes").alias("label"))
    two = F.struct(text.alias("text"), label.alias("label"))
    return F.when(F.col("row_id") % 2 == 0, F.array(one, two).cast(SHOTS_TYPE)).otherwise(no_shots())


def _prompts(*wordings: Wording) -> Query:
    def run(spark, sf):
        d = documents(spark, sf)
        shots = _two_shots(F.col("source"), F.lit("No"))
        return d.select(
            "row_id",
            *[
                classification_prompt(F.col("text"), TASK_TEXT, shots, w).alias(f"prompt_{i}")
                for i, w in enumerate(wordings)
            ],
        )

    return run


def number_prompts(spark, sf):
    d = parts(spark, sf)
    shots = _two_shots(F.col("text"), F.lit("1.0000"))
    return d.select(
        "row_id",
        *[
            regression_prompt(
                F.col("text"), PRICE_TEXT, F.col("label") - 800, F.col("label"), shots, w
            ).alias(f"prompt_{i}")
            for i, w in enumerate((REGRESSION, REGRESSION_SCORING))
        ],
    )


def _class_records(spark, sf, shots=3):
    split = prepare_classification(labelled(spark, sf), "text", "label", "source")
    config = RecordConfig("quality", TASK_TEXT, shots)
    return build_classification(split, config)


def task_records(spark, sf):
    """Every language a task of its own: split, searched and written out in the same jobs."""
    rows = documents(spark, sf).select("row_id", "text", "source", "lang")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    split = prepare_classification_tasks(rows.join(labels, "row_id"), "lang", "text", "label", "source")
    about = F.concat(F.lit(TASK_TEXT), F.lit(" of "), F.col("lang"))
    return build_classification_tasks(split, "lang", about, RecordConfig("", "", shots=3))


def priced_task_records(spark, sf):
    """Every manufacturer a task with a price range of its own."""
    rows = parts(spark, sf).withColumn("maker", maker(F.col("text")))
    about = F.concat(F.lit(PRICE_TEXT), F.lit(" by "), F.col("maker"))
    return build_regression_tasks(rows, "maker", about, RecordConfig("", "", shots=2))


def maker(text):
    """The first digit of the brand, which a part's text ends with."""
    return F.regexp_extract(text, r"#(\d)\d$", 1)


def classification_records(spark, sf):
    return _class_records(spark, sf)


def _price_records(spark, sf, shots=2):
    return build_regression(parts(spark, sf), RecordConfig("price", PRICE_TEXT, shots))


def regression_records(spark, sf):
    return _price_records(spark, sf)


def _scored_classes(style, shots: int, strategy: str = "similarity") -> Query:
    def run(spark, sf):
        records = materialise(_class_records(spark, sf, 0), "records")
        test, train = (records.where(F.col("split") == s).drop("split", "task") for s in ("test", "train"))
        prompts = scoring_prompts(test, train, TASK_TEXT, style, shots, strategy)
        return prompts.select("row_id", "instruction", "input", "output")

    return run


def _scored_prices(style, shots: int, strategy: str = "similarity") -> Query:
    def run(spark, sf):
        records = materialise(_price_records(spark, sf, 0), "records").drop("task")
        held_out = F.col("row_id") % 5 == 0
        prompts = scoring_prompts(
            records.where(held_out), records.where(~held_out), PRICE_TEXT, style, shots, strategy
        )
        return prompts.select("row_id", "instruction", "input", "output")

    return run


def _list_files(df, *columns: str) -> str:
    """Write rows as JSON lists of at most 500, files in the order of row_id."""
    path = scratch_path(df.sparkSession, "lists")
    write_record_lists(df.select("row_id", *columns), path, "row_id", [F.col(c) for c in columns])
    return f"{path}/part-*"


def merged_from_files(spark, sf):
    """Two sets of record files, one with another name for the source text, merged."""
    d = documents(spark, sf).select(
        "row_id", F.lit("read").alias("instruction"), F.col("text").alias("input"), F.col("lang").alias("output"),
        F.col("source").alias("original_text"), F.col("n_chars").alias("length"),
    )
    b = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"), F.lit("test").alias("instruction"), F.col("text").alias("input"),
        F.col("text").alias("original_smiles"),
    )
    fields = ("instruction", "input", "output", "original_text", "length")
    files = [_list_files(d, *fields), _list_files(b, "instruction", "input", "original_smiles")]
    rows = merge_shuffle([read_records(spark, [pattern])[0] for pattern in files])
    return rows.select(
        "row_id", "instruction", "input", "output", "original_text", F.element_at("other", "length").alias("length"), "source_no"
    )


def scored_from_files(spark, sf):
    """Record files of two splits to prompts."""
    records = materialise(_class_records(spark, sf, 0), "records")
    fields = ("instruction", "input", "output", "original_text")
    test, train = (
        read_records(spark, [_list_files(records.where(F.col("split") == s), *fields)], on_bad="fail")[0]
        for s in ("test", "train")
    )
    return scoring_prompts(test, train, TASK_TEXT, CLASSIFY, 3).select("instruction", "input", "output")


def scored_end_to_end(spark, sf):
    """Prompts, answers of a model, labels and metrics."""
    prompts = _scored_classes(CLASSIFY, 3)(spark, sf)
    return score(prompts, stub_model, CLASSIFY, "quality").metrics


def merged(spark, sf):
    d = documents(spark, sf).select("row_id", F.col("text").alias("input"), F.col("lang").alias("output"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("input"))
    return merge_shuffle([d, b])


def _joined(df, *columns):
    return df.select("row_id", *[F.array_join(c, ",").alias(c) for c in columns])


def concat_arrays(spark, sf):
    return _joined(sft_concat(conversation_records(spark, sf), word_ids, CONCAT_LENGTH), "input_ids", "labels")


def concat_arrays_bpe(spark, sf):
    """The same with a tokenizer learnt from the conversations themselves."""
    trained = bpe_train(word_counts(table(spark, sf, "conversations"), "text"))
    rows = conversation_records(spark, sf)
    return _joined(sft_concat(rows, lambda text: bpe_ids(text, trained), CONCAT_LENGTH), "input_ids", "labels")


def padded_arrays(spark, sf):
    rows = sft_padded(
        conversation_records(spark, sf), word_ids, 1, F.array(F.lit(2)), PADDED_LENGTH
    )
    return _joined(rows, "input_ids", "attention_mask", "labels")


def padded_batches(spark, sf):
    rows = sft_concat(conversation_records(spark, sf), word_ids, CONCAT_LENGTH)
    rows = pad_batches(rows, 8, 1)
    return rows.select(
        "row_id", "batch_id", F.array_join("input_ids", ",").alias("input_ids"),
        F.array_join("labels", ",").alias("labels"),
    )


QUERIES: dict[str, Query] = {
    "mask_token": masked_words,
    "value_range": label_range,
    "prompt_classification": _prompts(CLASSIFICATION, CLASSIFICATION_SCORING),
    "prompt_tagged": _prompts(CLASSIFICATION_TAGGED),
    "prompt_regression": number_prompts,
    "records_classification": classification_records,
    "records_regression": regression_records,
    "records_classification_tasks": task_records,
    "records_regression_tasks": priced_task_records,
    "scoring_prompts_tagged": _scored_classes(CLASSIFY, 3),
    "scoring_prompts_diversity": _scored_classes(CLASSIFY_STRATEGIES, 4, "diversity"),
    "scoring_prompts_similarity": _scored_classes(CLASSIFY_STRATEGIES, 2),
    "scoring_prompts_random_pool": _scored_classes(CLASSIFY_STRATEGIES, 2, "random"),
    "scoring_prompts_regression": _scored_prices(REGRESS, 2),
    "scoring_prompts_regression_similarity": _scored_prices(REGRESS_STRATEGIES, 2),
    "scoring_prompts_regression_random": _scored_prices(REGRESS_STRATEGIES, 2, "random"),
    "merge_shuffle": merged,
    "merge_from_files": merged_from_files,
    "scoring_from_files": scored_from_files,
    "score_classification": scored_end_to_end,
    "sft_concat": concat_arrays,
    "sft_concat_bpe": concat_arrays_bpe,
    "sft_padded": padded_arrays,
    "pad_batches": padded_batches,
}


def _fill(pattern: str, values: dict[str, str]) -> str:
    sql = quote(pattern)
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def prompt_sql(w: Wording, text: str, examples: str, values: dict[str, str], empty: str | None = None) -> str:
    """``examples`` is SQL of the joined examples, NULL for none."""
    query = f"{quote(w.text_tag)} || {text} || {quote(chr(10) + w.ending)}"
    lead = _fill(w.opening + w.answer_rule, values)
    none = empty or f"{lead} || {quote(w.zero_shot_note)} || {query}"
    return (
        f"CASE WHEN {examples} IS NULL THEN {none} ELSE {lead} || {quote(w.examples_header)} || "
        f"{examples} || {quote(w.query_header)} || {query} END"
    )


def example_sql(w: Wording, text: str, label: str) -> str:
    return f"{quote(w.text_tag)} || {text} || {quote(chr(10) + w.label_tag)} || {label} || {quote(chr(10) * 2)}"


def _examples_of_two(w: Wording, text: str, label: str) -> str:
    both = f"{example_sql(w, quote('first'), quote('Yes'))} || {example_sql(w, text, label)}"
    return f"(CASE WHEN row_id % 2 = 0 THEN {both} END)"


def _prompt_columns(wordings, text, shot_text, shot_label, values) -> str:
    return ", ".join(
        f"{prompt_sql(w, text, _examples_of_two(w, shot_text, shot_label), values)} AS prompt_{i}"
        for i, w in enumerate(wordings)
    )


_TASK = {"task": quote(TASK_TEXT)}
_PRICE = {"task": quote(PRICE_TEXT)}
_DOCS = "(SELECT doc_id AS row_id, text, source FROM documents)"
_MASKED = word_mask("text", "'42:' || row_id || ':query'")[0]
_FRESH = word_mask("t.text", "'42:' || query_id || ':shot:' || neighbour_id")[0]

_CLASS_SHOTS = f"""WITH {FP}, train AS (SELECT * FROM fps WHERE split = 'train'),
  {neighbours('fps', 'train', 3, 'q.row_id <> c.row_id')},
  shots AS (SELECT query_id, string_agg({example_sql(CLASSIFICATION, _FRESH, 't.output')}, '' ORDER BY rank) AS examples
    FROM near n JOIN train t ON t.row_id = n.neighbour_id GROUP BY query_id),
  shown AS (SELECT s.*, {_MASKED} AS input FROM fps s)"""

_TASK_SHOTS = f"""WITH tasked AS ({SPLIT_TASKS}),
  fps AS (SELECT t.*, d.text, {fp('d.text')} AS fp, CASE WHEN t.label = 1 THEN 'Yes' ELSE 'No' END AS output
    FROM tasked t JOIN documents d ON d.doc_id = t.row_id),
  train AS (SELECT * FROM fps WHERE split = 'train'),
  {neighbours('fps', 'train', 3, 'q.row_id <> c.row_id AND q.lang = c.lang')},
  shots AS (SELECT query_id, string_agg({example_sql(CLASSIFICATION, _FRESH, 't.output')}, '' ORDER BY rank) AS examples
    FROM near n JOIN train t ON t.row_id = n.neighbour_id GROUP BY query_id),
  shown AS (SELECT s.*, {_MASKED} AS input FROM fps s)"""

_PRICE_RANGE = {
    **_PRICE,
    "low": "(SELECT printf('%.2f', min(label)) FROM parts)",
    "high": "(SELECT printf('%.2f', max(label)) FROM parts)",
}
_PRICE_SHOTS = f"""WITH {PART_NEAR},
  shots AS (SELECT query_id,
      string_agg({example_sql(REGRESSION, 'p.text', "printf('%.4f', p.label)")}, '' ORDER BY rank) AS examples
    FROM near JOIN parts p ON p.row_id = neighbour_id WHERE rank <= 2 GROUP BY query_id),
  shown AS (SELECT p.*, {_MASKED} AS input FROM parts p)"""

_MAKER = r"regexp_extract(text, '#(\d)\d$', 1)"
_MADE_SHOTS = f"""WITH {PARTS},
  made AS (SELECT *, {fp('text')} AS fp, {_MAKER} AS maker FROM parts),
  ranges AS (SELECT maker, printf('%.2f', min(label)) AS low, printf('%.2f', max(label)) AS high FROM made GROUP BY 1),
  {neighbours('made', 'made', 2, 'q.row_id <> c.row_id AND q.maker = c.maker')},
  shots AS (SELECT query_id,
      string_agg({example_sql(REGRESSION, 'p.text', "printf('%.4f', p.label)")}, '' ORDER BY rank) AS examples
    FROM near JOIN made p ON p.row_id = neighbour_id GROUP BY query_id HAVING count(*) >= 2),
  shown AS (SELECT p.*, r.low, r.high, {_MASKED} AS input FROM made p JOIN ranges r USING (maker)
    WHERE p.row_id IN (SELECT query_id FROM shots))"""

_STORED = f"""{FP}, records AS (SELECT *, {_MASKED} AS input FROM fps),
  train AS (SELECT * FROM records WHERE split = 'train'), asked AS (SELECT * FROM records WHERE split = 'test')"""

_DIVERSE = f"""WITH {_STORED}, {neighbours('asked', 'train', 50)},
  pool AS (SELECT n.*, t.output AS label, t.text AS shot_text, {h("'42:pick:' || query_id || ':' || neighbour_id")} AS chance,
      {h("'42:order:' || query_id || ':' || neighbour_id")} AS shuffle
    FROM near n JOIN train t ON t.row_id = n.neighbour_id),
  drawn AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY chance, neighbour_id) AS n FROM pool),
  shots AS (SELECT query_id,
      CASE WHEN count(*) >= 4 THEN string_agg({example_sql(CLASSIFICATION_SCORING, 'shot_text', 'label')}, ''
        ORDER BY shuffle, neighbour_id) END AS examples
    FROM drawn WHERE n <= 2 GROUP BY query_id)"""

# Held-out parts; the range comes from the labels of the others as stored, with four decimals.
_HELD_OUT = f"""{PARTS},
  records AS (SELECT *, {_MASKED} AS input, printf('%.4f', label) AS output FROM parts),
  train AS (SELECT * FROM records WHERE row_id % 5 <> 0), asked AS (SELECT * FROM records WHERE row_id % 5 = 0)"""
_TRAIN_RANGE = {
    **_PRICE,
    "low": "(SELECT printf('%.2f', min(output::DOUBLE)) FROM train)",
    "high": "(SELECT printf('%.2f', max(output::DOUBLE)) FROM train)",
}
_HELD_OUT_NEAR = f"""WITH {PART_NEAR.split('near AS (')[0].rstrip().rstrip(',')},
  records AS (SELECT *, {_MASKED} AS input, printf('%.4f', label) AS output FROM parts),
  train AS (SELECT * FROM records WHERE row_id % 5 <> 0), asked AS (SELECT * FROM records WHERE row_id % 5 = 0),
  near AS (SELECT * FROM (
    SELECT q.row_id AS query_id, c.row_id AS neighbour_id,
      row_number() OVER (PARTITION BY q.row_id ORDER BY similarity DESC, c.row_id) AS rank
    FROM members q JOIN set_pairs p ON p.a = q.set_id JOIN members c ON c.set_id = p.b
    WHERE q.row_id % 5 = 0 AND c.row_id % 5 <> 0) WHERE rank <= 2),
  shots AS (SELECT query_id, string_agg({example_sql(REGRESSION, 't.text', 't.output')}, '' ORDER BY rank) AS examples
    FROM near JOIN train t ON t.row_id = neighbour_id GROUP BY query_id)"""
_HELD_OUT_RANDOM = f"""WITH {_HELD_OUT},
  numbered AS (SELECT row_id AS neighbour_id, row_number() OVER (ORDER BY row_id) - 1 AS position,
    count(*) OVER () AS n FROM train),
  first AS (SELECT row_id AS query_id, n, {h("'42:position:0:' || row_id")} % (n - 1) AS a,
    {h("'42:position:1:' || row_id")} % n AS b FROM asked, (SELECT max(n) AS n FROM numbered)),
  drawn AS (SELECT query_id, unnest([a, CASE WHEN a = b THEN n - 1 ELSE b END]) AS position FROM first),
  shots AS (SELECT query_id, string_agg({example_sql(REGRESSION_SCORING, 't.text', 't.output')}, ''
      ORDER BY {h("'42:order:' || query_id || ':' || neighbour_id")}, neighbour_id) AS examples
    FROM drawn JOIN numbered USING (position) JOIN train t ON t.row_id = neighbour_id GROUP BY query_id)"""

_SFT = f"""WITH {CONVERSATIONS},
  coded AS (SELECT row_id, {ids(strip('instruction') + " || chr(10) || " + strip('input'))}[:{CONCAT_LENGTH}] AS p,
    {ids(strip('output'))} AS t FROM turns),
  cut AS (SELECT row_id, p, t[:greatest({CONCAT_LENGTH} - len(p) - 1, 0)] AS t FROM coded),
  arrays AS (SELECT row_id, list_concat(p, t) AS input_ids,
    list_concat(list_transform(p, lambda x: -100), t) AS labels FROM cut)"""
_PROMPT_TEXT = "'Instruction:' || chr(10) || instruction || chr(10) || chr(10) || 'Input:' || chr(10) || input || chr(10) || chr(10) || 'Output:' || chr(10)"


_TAGGED_SHOTS = f"""WITH {_STORED}, {neighbours('asked', 'train', 3)},
  shots AS (SELECT query_id, string_agg({example_sql(CLASSIFICATION_TAGGED, 't.input', 't.output')}, '' ORDER BY rank) AS examples
    FROM near n JOIN train t ON t.row_id = n.neighbour_id GROUP BY query_id)"""
_NEAREST_SHOTS = f"""WITH {_STORED}, {neighbours('asked', 'train', 2)},
  shots AS (SELECT query_id, CASE WHEN count(*) >= 2 THEN
      string_agg({example_sql(CLASSIFICATION_SCORING, 't.text', 't.output')}, '' ORDER BY rank) END AS examples
    FROM near n JOIN train t ON t.row_id = n.neighbour_id GROUP BY query_id)"""
_POOL_SHOTS = f"""{_DIVERSE.split('drawn AS (')[0]}
  drawn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chance, neighbour_id) AS n,
    count(*) OVER (PARTITION BY query_id) AS size FROM pool),
  shots AS (SELECT query_id, string_agg({example_sql(CLASSIFICATION_SCORING, 'shot_text', 'label')}, ''
      ORDER BY shuffle, neighbour_id) AS examples
    FROM drawn WHERE n <= 2 AND size >= 2 GROUP BY query_id)"""


def _from_shots(with_ctes: str, source: str, prompt: str, output: str, columns: str = "") -> str:
    return f"""{with_ctes}
      SELECT s.row_id, {columns} {prompt} AS instruction, input, {output} AS output
      FROM {source} s LEFT JOIN shots ON shots.query_id = s.row_id"""


_TAGGED_SQL = _from_shots(
    _TAGGED_SHOTS, "asked", prompt_sql(CLASSIFICATION_TAGGED, "input", "examples", _TASK), "s.output"
)

ORACLES: dict[str, str] = {
    "mask_token": f"""SELECT row_id, {word_mask('text', "'42:' || row_id")[0]} AS masked,
      {word_mask('text', "'42:' || row_id")[1]} AS mask_tag FROM {_DOCS}""",
    "value_range": f"WITH {PARTS} SELECT coalesce(min(label), 0) AS low, coalesce(max(label), 0) AS high FROM parts",
    "prompt_classification": f"""SELECT row_id,
      {_prompt_columns((CLASSIFICATION, CLASSIFICATION_SCORING), 'text', 'source', quote('No'), _TASK)} FROM {_DOCS}""",
    "prompt_tagged": f"""SELECT row_id,
      {_prompt_columns((CLASSIFICATION_TAGGED,), 'text', 'source', quote('No'), _TASK)} FROM {_DOCS}""",
    "prompt_regression": f"""WITH {PARTS} SELECT row_id, {_prompt_columns(
        (REGRESSION, REGRESSION_SCORING), 'text', 'text', quote('1.0000'),
        {**_PRICE, 'low': "printf('%.2f', label - 800)", 'high': "printf('%.2f', label)"})} FROM parts""",
    "records_classification": _from_shots(
        _CLASS_SHOTS, "shown", prompt_sql(CLASSIFICATION, "input", "examples", _TASK), "s.output",
        "'quality' AS task, split, text AS original_text,",
    ),
    "records_regression": _from_shots(
        _PRICE_SHOTS, "shown", prompt_sql(REGRESSION, "input", "examples", _PRICE_RANGE),
        "printf('%.4f', label)", "'price' AS task, text AS original_text,",
    ),
    "records_classification_tasks": _from_shots(
        _TASK_SHOTS, "shown", prompt_sql(CLASSIFICATION, "input", "examples", {"task": f"{quote(TASK_TEXT + ' of ')} || s.lang"}),
        "s.output", "s.lang AS task, split, text AS original_text,",
    ),
    "records_regression_tasks": _from_shots(
        _MADE_SHOTS, "shown",
        prompt_sql(REGRESSION, "input", "examples", {"task": f"{quote(PRICE_TEXT + ' by ')} || maker", "low": "low", "high": "high"}),
        "printf('%.4f', label)", "maker AS task, text AS original_text,",
    ),
    "scoring_prompts_tagged": _TAGGED_SQL,
    "scoring_from_files": f"SELECT instruction, input, output FROM ({_TAGGED_SQL})",
    "score_classification": f"""WITH asked AS ({_TAGGED_SQL}),
      hashed AS (SELECT *, {h('instruction')} AS n FROM asked),
      parsed AS (SELECT (output = 'Yes')::INTEGER AS t, CASE WHEN n % 97 = 0 THEN NULL WHEN n % 3 = 0 THEN 1 WHEN n % 3 = 1 THEN 0 END AS y,
        CASE WHEN n % 97 <> 0 THEN (n % 101) / 100.0::DOUBLE END AS u FROM hashed),
      judged AS (SELECT t, coalesce(y, (u >= 0.5)::INTEGER, 0) AS p, coalesce(y::DOUBLE, u, 0.5) AS s FROM parsed),
      points AS (SELECT s, sum(t) AS tp, sum(1 - t) AS fp FROM judged GROUP BY 1),
      curve AS (SELECT *, sum(tp) OVER (ORDER BY s DESC) - tp AS tpb FROM points)
      SELECT 'quality' AS task, 'similarity' AS strategy, 'AUC' AS metric,
        round(sum(fp * (tpb + tp / 2)) / nullif(sum(tp) * sum(fp), 0), 4) AS value FROM curve
      UNION ALL SELECT 'quality', 'similarity', 'ACC', round(avg((t = p)::INTEGER), 4) FROM judged""",
    "scoring_prompts_similarity": _from_shots(
        _NEAREST_SHOTS, "asked", prompt_sql(CLASSIFICATION_SCORING, "input", "examples", _TASK), "s.output"
    ),
    "scoring_prompts_random_pool": _from_shots(
        _POOL_SHOTS, "asked", prompt_sql(CLASSIFICATION_SCORING, "input", "examples", _TASK), "s.output"
    ),
    "scoring_prompts_regression_similarity": _from_shots(
        _HELD_OUT_NEAR.replace(quote(REGRESSION.text_tag), quote(REGRESSION_SCORING.text_tag)), "asked",
        prompt_sql(REGRESSION_SCORING, "input", "examples", _TRAIN_RANGE), "s.output",
    ),
    "merge_from_files": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, 'read' AS instruction, text AS input,
        lang AS output, source AS original_text, n_chars::VARCHAR AS length, 0 AS source_no FROM documents
      UNION ALL SELECT row_number() OVER (ORDER BY item_id) - 1, 'test', text, NULL, text, NULL, 1 FROM benchmark""",
    "scoring_prompts_diversity": _from_shots(
        _DIVERSE, "asked", prompt_sql(CLASSIFICATION_SCORING, "input", "examples", _TASK), "s.output"
    ),
    "scoring_prompts_regression": _from_shots(
        _HELD_OUT_NEAR, "asked", prompt_sql(REGRESSION, "input", "examples", _TRAIN_RANGE), "s.output"
    ),
    "scoring_prompts_regression_random": _from_shots(
        _HELD_OUT_RANDOM, "asked", prompt_sql(REGRESSION_SCORING, "input", "examples", _TRAIN_RANGE), "s.output"
    ),
    "merge_shuffle": f"""SELECT doc_id AS row_id, text AS input, lang AS output,
        {h("'42:0:' || doc_id")} AS position_hash, 0 AS source_no FROM documents
      UNION ALL SELECT item_id, text, NULL, {h("'42:1:' || item_id")}, 1 FROM benchmark""",
    "sft_concat": f"""{_SFT} SELECT row_id, array_to_string(input_ids, ',') AS input_ids,
      array_to_string(labels, ',') AS labels FROM arrays""",
    "sft_padded": f"""WITH {CONVERSATIONS},
      coded AS (SELECT row_id, least(len({ids(_PROMPT_TEXT)}), {PADDED_LENGTH}) AS hidden,
        list_concat({ids(_PROMPT_TEXT + " || output")}, [2])[:{PADDED_LENGTH}] AS f FROM turns),
      wide AS (SELECT *, list_concat(f, list_transform(range({PADDED_LENGTH} - len(f)), lambda x: 1)) AS w FROM coded)
      SELECT row_id, array_to_string(w, ',') AS input_ids,
        array_to_string(list_transform(range(1, {PADDED_LENGTH} + 1), lambda i: CASE WHEN i <= len(f) THEN 1 ELSE 0 END), ',') AS attention_mask,
        array_to_string(list_transform(range(1, {PADDED_LENGTH} + 1), lambda i: CASE WHEN i <= hidden THEN -100 ELSE w[i] END), ',') AS labels
      FROM wide""",
    "pad_batches": f"""{_SFT},
      numbered AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch_id FROM arrays),
      sized AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS w FROM numbered)
      SELECT row_id, batch_id,
        array_to_string(list_concat(input_ids, list_transform(range(w - len(input_ids)), lambda x: 1)), ',') AS input_ids,
        array_to_string(list_concat(labels, list_transform(range(w - len(labels)), lambda x: 1)), ',') AS labels
      FROM sized""",
}
