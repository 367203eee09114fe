"""Sources, cleaning, split and balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    CLEANED, LABELLED, PARTS, Query, SPLIT, documents, h, key, labelled, parts, split_of, table,
)
from shotweave.functions.hashing import portable_hash
from shotweave.functions.text import format_label, label_text, retrieval_text, rotations
from shotweave.operators.balance import class_stats, oversample_minority
from shotweave.operators.cleaning import (
    coerce_label, coerce_numeric, dedup_keep_first, drop_missing, keep_large_tasks,
    sample_exact, sample_fraction, with_canonical_key,
)
from shotweave.operators.split import group_split, with_group_key
from shotweave.plans.records import (
    clean_classification, prepare_classification, prepare_classification_tasks,
)
from shotweave.sources.records import (
    read_record_lines, read_records, write_record_lists, write_records,
)
from shotweave.sources.tables import read_corpus, read_task
from shotweave.storage import scratch_path


def split_report(spark, sf):
    """What would train, validation and test look like?"""
    split = prepare_classification(labelled(spark, sf), "text", "label", "source")
    return split.groupBy("split", "label").agg(F.count("*").alias("n"))


def split_tasks(spark, sf):
    """Every language a task of its own, all cleaned and split in the same jobs."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    rows = documents(spark, sf).select("row_id", "text", "source", "lang").join(labels, "row_id")
    split = prepare_classification_tasks(rows, "lang", "text", "label", "source")
    return split.select("row_id", "lang", "label", "split")


def read_task_csv(spark, sf):
    path = scratch_path(spark, "csv")
    source = documents(spark, sf).select(F.col("row_id").alias("doc_id"), "text", "lang").orderBy("doc_id")
    source.write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    read = read_task(spark, path, "text", "lang")
    return read.select("row_id", F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def corpus(spark, sf):
    return read_corpus(spark, f"{sf}/documents.parquet", "text")


def _record_fields():
    return [
        F.concat(F.lit("Q "), F.col("row_id")).alias("instruction"), F.col("text").alias("input"),
        F.col("lang").alias("output"), F.col("text").alias("original_text"),
    ]


def _records(spark, sf):
    return documents(spark, sf).select(
        "row_id", F.col("lang").alias("task"), F.col("source").alias("split"), *_record_fields()
    )


def record_lists(spark, sf):
    """Lists of at most 500 records, one file each, read through two patterns."""
    path = scratch_path(spark, "lists")
    write_record_lists(documents(spark, sf).select("row_id", "text", "lang"), path, "row_id", _record_fields())
    records, _ = read_records(spark, [f"{path}/*.txt", f"{path}/part-*"])
    return records.drop("other", "row_id")


def record_lines(spark, sf):
    path = scratch_path(spark, "records")
    write_records(_records(spark, sf), path)
    read = spark.read.schema("row_id bigint, task string, split string, instruction string, input string, output string, original_text string").json(path)
    return read.select("row_id", "task", "split", "instruction", "input", "output", "original_text")


def no_missing(spark, sf):
    d = documents(spark, sf).withColumn("lang", F.nullif("lang", F.lit("en")))
    return drop_missing(d, "text", "lang").select("row_id", "lang")


_MESSY = [" 0.7 ", "1f", "1d", "inf", "abc", "-1.5e2", "7.", ".25", None, ""]


def _messy(spark, sf):
    pick = F.pmod(portable_hash("m", F.col("row_id")), F.lit(len(_MESSY))).cast("int")
    return documents(spark, sf).select(
        "row_id", F.get(F.array(*[F.lit(x) for x in _MESSY]), pick).alias("label")
    )


def numbers(spark, sf):
    return coerce_numeric(_messy(spark, sf), "label")


def whole_labels(spark, sf):
    shifted = parts(spark, sf).select("row_id", (F.col("label") - 950).alias("label"))
    return coerce_label(shifted, "label")


def keys(spark, sf):
    return with_canonical_key(documents(spark, sf), "text").select("row_id", "canonical_key")


def first_rows(spark, sf):
    d = documents(spark, sf).select("row_id", "text", "source")
    return dedup_keep_first(with_canonical_key(d, "text"))


def large_tasks(spark, sf):
    return keep_large_tasks(labelled(spark, sf), "source").select("row_id", "source", "label")


def sampled(spark, sf):
    return sample_fraction(documents(spark, sf), 0.1).select("row_id", "text")


def sampled_exact(spark, sf):
    return sample_exact(documents(spark, sf).select("row_id", "text"), 0.1)


def labels_as_text(spark, sf):
    d = labelled(spark, sf)
    return d.select("row_id", label_text(F.col("label") + F.col("row_id") % 2).alias("label_text"))


def labels_formatted(spark, sf):
    return parts(spark, sf).select("row_id", format_label(F.col("label")).alias("label_text"))


def lookup_texts(spark, sf):
    pick = F.pmod(portable_hash("o", F.col("row_id")), F.lit(3))
    original = F.when(pick == 0, F.lit("")).when(pick == 1, F.col("text"))
    return documents(spark, sf).select(
        "row_id", retrieval_text(original, F.col("lang"), "or").alias("or_rule"),
        retrieval_text(original, F.col("lang"), "default").alias("default_rule"),
    )


def group_keys(spark, sf):
    pick = F.pmod(portable_hash("g", F.col("row_id")), F.lit(3))
    group = F.when(pick == 0, F.lit("")).when(pick == 1, F.col("source"))
    return with_group_key(documents(spark, sf), group, "text").select("row_id", "group_key")


def split_rows(spark, sf):
    cleaned = clean_classification(labelled(spark, sf), "text", "label")
    split = group_split(with_group_key(cleaned, "source", "text"))
    return split.select("row_id", "group_key", "split")


def split_lineitem(spark, sf):
    """Order lines split by part: many groups, many rows."""
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_partkey"
    )
    return group_split(lines, "l_partkey").select("row_id", "l_partkey", "split")


def statistics(spark, sf):
    return class_stats(labelled(spark, sf), "label")


def oversampled(spark, sf):
    split = prepare_classification(labelled(spark, sf), "text", "label", "source", augment=True)
    return split.where(F.col("split") == "train").select("row_id", "text", "label", "is_augmented")


def variants(spark, sf):
    return parts(spark, sf).select("row_id", F.posexplode(rotations(F.col("text"))).alias("place", "variant"))


_MESSY_SQL = "[' 0.7 ', '1f', '1d', 'inf', 'abc', '-1.5e2', '7.', '.25', NULL, '']"
_TURN = "array_to_string(list_concat(t[i + 1:], t[:i]), ' ')"


def _rotated(text: str, source: str, extra: str = "") -> str:
    """Distinct rotations of the words of each row of ``source``, in order."""
    return f"""
tokens AS (
  SELECT *, string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' ') AS t FROM {source}),
turned AS (
  SELECT * EXCLUDE (i), i AS place, {_TURN} AS variant
  FROM (SELECT *, unnest(range(1, least(len(t) - 1, 10) + 1)) AS i FROM tokens WHERE len(t) > 1)),
rotated AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, variant ORDER BY place) AS seen
    FROM turned WHERE variant <> array_to_string(t, ' ')) WHERE seen = 1)"""


QUERIES: dict[str, Query] = {
    "split_report": split_report,
    "split_tasks": split_tasks,
    "read_task_csv": read_task_csv,
    "read_corpus": corpus,
    "read_records": record_lists,
    "write_records": record_lines,
    "drop_missing": no_missing,
    "coerce_numeric": numbers,
    "int_label": whole_labels,
    "canonical_key": keys,
    "dedup_keep_first": first_rows,
    "min_rows_gate": large_tasks,
    "sample_fraction": sampled,
    "sample_exact": sampled_exact,
    "label_text": labels_as_text,
    "format_label": labels_formatted,
    "retrieval_text": lookup_texts,
    "group_key": group_keys,
    "group_split": split_rows,
    "group_split_lineitem": split_lineitem,
    "class_stats": statistics,
    "oversample_minority": oversampled,
    "text_variants": variants,
}

_RECORDS_SQL = """SELECT 'Q ' || doc_id AS instruction, text AS input, lang AS output, text AS original_text"""

ORACLES: dict[str, str] = {
    "split_report": f"WITH {SPLIT} SELECT split, label, count(*) AS n FROM split_rows GROUP BY 1, 2",
    "split_tasks": f"""WITH rows AS (
      SELECT d.doc_id AS row_id, d.text, d.source, d.lang, l.quality::BIGINT AS label
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    first_rows AS (
      SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, {key('text')} ORDER BY row_id) AS k
        FROM rows WHERE {key('text')} IS NOT NULL AND lang IS NOT NULL) WHERE k = 1),
    sizes AS (
      SELECT lang, source, count(*) AS size, min(row_id) AS first_row FROM first_rows WHERE c >= 20 GROUP BY 1, 2),
    placed AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY lang ORDER BY size DESC, first_row
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(size) OVER (PARTITION BY lang) AS n FROM sizes),
    filled AS (
      SELECT *, sum(CASE WHEN before / n < 0.1 THEN size ELSE 0 END) OVER (PARTITION BY lang) AS v FROM placed)
    SELECT r.row_id, r.lang, r.label, CASE WHEN before / n < 0.1 THEN 'validation'
      WHEN (before - v) / n < 0.1 THEN 'test' ELSE 'train' END AS split
    FROM first_rows r JOIN filled f ON r.lang = f.lang AND r.source = f.source""",
    "read_task_csv": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, text, lang FROM documents",
    "read_corpus": "SELECT text FROM documents WHERE text IS NOT NULL",
    "read_records": f"{_RECORDS_SQL} FROM documents UNION ALL {_RECORDS_SQL} FROM documents",
    "write_records": f"""{_RECORDS_SQL}, doc_id AS row_id, lang AS task, source AS split FROM documents""",
    "drop_missing": "SELECT doc_id AS row_id, lang FROM documents WHERE text IS NOT NULL AND lang <> 'en'",
    "coerce_numeric": f"""
      WITH messy AS (SELECT doc_id AS row_id, trim({_MESSY_SQL}[1 + {h("'m:' || doc_id")} % 10]) AS x FROM documents)
      SELECT row_id, try_cast(x AS DOUBLE) AS label FROM messy
      WHERE regexp_full_match(x, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')""",
    "int_label": f"WITH {PARTS} SELECT row_id, trunc(label - 950)::BIGINT AS label FROM parts",
    "canonical_key": f"""SELECT doc_id AS row_id, {key('text')} AS canonical_key FROM documents
      WHERE {key('text')} IS NOT NULL""",
    "dedup_keep_first": f"""SELECT row_id, text, source FROM (
      SELECT doc_id AS row_id, text, source,
        row_number() OVER (PARTITION BY {key('text')} ORDER BY doc_id) AS n
      FROM documents WHERE {key('text')} IS NOT NULL) WHERE n = 1""",
    "min_rows_gate": f"""WITH {LABELLED} SELECT row_id, source, label FROM labelled WHERE source IN (
      SELECT source FROM labelled GROUP BY 1 HAVING count(*) >= 20)""",
    "sample_fraction": f"""SELECT doc_id AS row_id, text FROM documents
      WHERE {h("'42:' || doc_id")} / 4294967296.0 < 0.1""",
    "sample_exact": f"""SELECT row_id, text FROM (SELECT doc_id AS row_id, text,
      row_number() OVER (ORDER BY {h("'42:' || doc_id")}, doc_id) AS n, count(*) OVER () AS total FROM documents)
      WHERE n <= round_even(total * 0.1, 0)""",
    "label_text": f"""WITH {LABELLED} SELECT row_id,
      CASE WHEN label + row_id % 2 = 1 THEN 'Yes' ELSE 'No' END AS label_text FROM labelled""",
    "format_label": f"WITH {PARTS} SELECT row_id, printf('%.4f', label) AS label_text FROM parts",
    "retrieval_text": f"""WITH o AS (SELECT doc_id AS row_id, lang,
        CASE {h("'o:' || doc_id")} % 3 WHEN 0 THEN '' WHEN 1 THEN text END AS original FROM documents)
      SELECT row_id, coalesce(nullif(original, ''), lang) AS or_rule, coalesce(original, lang) AS default_rule
      FROM o""",
    "group_key": f"""SELECT doc_id AS row_id,
      CASE WHEN {h("'g:' || doc_id")} % 3 = 1 THEN source ELSE text END AS group_key FROM documents""",
    "group_split": f"WITH {SPLIT} SELECT row_id, source AS group_key, split FROM split_rows",
    "group_split_lineitem": f"""WITH lines AS (
        SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey FROM lineitem),
      {split_of('lines', 'l_partkey')} SELECT row_id, l_partkey, split FROM split_rows""",
    "class_stats": f"""WITH {LABELLED},
      counts AS (SELECT label, count(*) AS n, min(row_id) AS first_row FROM labelled GROUP BY 1)
      SELECT count(*) AS classes,
        (SELECT label FROM counts ORDER BY n DESC, first_row LIMIT 1) AS majority, max(n) AS majority_rows,
        (SELECT label FROM counts ORDER BY n, first_row LIMIT 1) AS minority, min(n) AS minority_rows,
        max(n) / min(n) AS ratio FROM counts""",
    "oversample_minority": f"""WITH {SPLIT},
      train AS (SELECT row_id, text, label FROM split_rows WHERE split = 'train'),
      counts AS (SELECT label, count(*) AS n, min(row_id) AS first_row FROM train GROUP BY 1),
      stats AS (SELECT (SELECT label FROM counts ORDER BY n, first_row LIMIT 1) AS minority,
        max(n) // 5 - min(n) AS missing FROM counts HAVING count(*) >= 2 AND max(n) > 5 * min(n)),
      rare AS (SELECT * FROM train WHERE label = (SELECT minority FROM stats)),
      {_rotated('text', 'rare')},
      sources AS (SELECT row_id, any_value(label) AS label, list(variant ORDER BY place) AS v,
          {h("'42:' || row_id")} AS hash FROM rotated GROUP BY row_id),
      ranked AS (SELECT *, row_number() OVER (ORDER BY hash, row_id) - 1 AS r, count(*) OVER () AS m FROM sources),
      copies AS (SELECT *, unnest(range(0, missing // m + CASE WHEN r < missing % m THEN 1 ELSE 0 END)) AS c
        FROM ranked, stats)
      SELECT row_id, text, label, false AS is_augmented FROM train
      UNION ALL
      SELECT (SELECT max(row_id) FROM train) + 1 + c * m + r, v[1 + (hash + c) % len(v)], label, true FROM copies""",
    "text_variants": f"""WITH {PARTS}, {_rotated('text', 'parts')}
      SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY place) - 1)::INTEGER AS place, variant FROM rotated""",
}
