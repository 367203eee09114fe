"""Inputs of the registered queries and the SQL pieces their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.functions.hashing import portable_hash
from shotweave.functions.text import words
from shotweave.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
TASK_TEXT = "decide whether the quality is high"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).withColumnRenamed("doc_id", "row_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Classification task: text, source, label."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    texts = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", "source"))
    return texts.join(labels, "row_id")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Regression task: text, label."""
    return spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("row_id"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"),
        F.col("p_retailprice").alias("label"),
    )


ANSWERS = ["Yes", " no.", "YES indeed", "None", "maybe", "", None, "\n"]
NUMBERS = ["12.5", "about -3", ".5e-3", "1e-5", "n/a", ""]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to every event, chosen by hash."""
    e = spread(table(spark, sf, "events"))
    i = F.col("event_id")
    low = F.when(F.col("user_id") % 2 == 0, F.lit("_low")).otherwise(F.lit(""))

    def choose(options: list, salt: str) -> Column:
        return F.get(F.lit(options) if None not in options else F.array(*[F.lit(o) for o in options]),
                     F.pmod(portable_hash(salt, i), F.lit(len(options))).cast("int"))

    return e.select(
        i.alias("row_id"),
        F.concat(F.col("event_type"), low).alias("task"),
        F.get(F.lit(["similarity", "random"]), F.pmod(portable_hash("s", i), F.lit(2)).cast("int")).alias("strategy"),
        F.when(portable_hash("y", i) % 3 == 0, F.lit(" YES ")).otherwise(F.lit("No")).alias("output"),
        F.col("value"),
        choose(ANSWERS, "out").alias("model_output"),
        choose(NUMBERS, "num").alias("number_output"),
        ((portable_hash("p", i) % 101) / 100.0).alias("p_yes"),
        ((portable_hash("n", i) % 101) / 100.0).alias("p_no"),
        (portable_hash("f", i) % 11 == 0).alias("failed"),
    )


def word_ids(text: Column) -> Column:
    """Hashed word vocabulary: a tokenizer SQL can repeat."""
    ids = F.transform(words(text), lambda w: (portable_hash(w) % 30000 + 3).cast("int"))
    return F.coalesce(ids, F.array().cast("array<int>"))


def conversation_records(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn with the assistant turn that follows it."""
    c = table(spark, sf, "conversations")
    user = c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction")
    )
    answer = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return user.join(answer, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "instruction",
        F.lit(" context ").alias("input"), "output",
    )


# --- SQL ---------------------------------------------------------------------


def h(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def key(text: str) -> str:
    return rf"nullif(trim(regexp_replace(lower({text}), '\s+', ' ', 'g')), '')"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def fp(text: str) -> str:
    """Sorted bit positions of the words of a text."""
    return (
        f"list_sort(list_distinct(list_transform(list_distinct(string_split({key(text)}, ' ')), "
        f"lambda w: (({h('w')}) % 2048)::INTEGER)))"
    )


def ids(text: str) -> str:
    return (
        f"coalesce(list_transform(string_split({key(text)}, ' '), "
        f"lambda w: (({h('w')}) % 30000 + 3)::INTEGER), [])"
    )


def quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


LABELLED = """labelled AS (
  SELECT d.doc_id AS row_id, d.text, d.source, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

CLEANED = f"""{LABELLED},
cleaned AS (
  SELECT row_id, text, source, label::BIGINT AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY {key('text')} ORDER BY row_id) AS n
    FROM labelled WHERE {key('text')} IS NOT NULL) WHERE n = 1)"""


def split_of(rows: str, group: str, name: str = "split_rows") -> str:
    """CTEs that add ``split`` to the rows of a CTE."""
    return f"""
group_sizes AS (
  SELECT {group} AS g, count(*) AS size, min(row_id) AS first_row FROM {rows} GROUP BY 1),
group_order AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, first_row
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS n FROM group_sizes),
group_valid AS (SELECT coalesce(sum(size), 0) AS v FROM group_order WHERE before / n < 0.1),
group_split AS (
  SELECT g, CASE WHEN before / n < 0.1 THEN 'validation'
    WHEN (before - v) / n < 0.1 THEN 'test' ELSE 'train' END AS split
  FROM group_order, group_valid),
{name} AS (SELECT r.*, s.split FROM {rows} r JOIN group_split s ON r.{group} = s.g)"""


SPLIT = f"{CLEANED}, {split_of('cleaned', 'source')}"

PREDICTIONS = f"""predictions AS (
  SELECT event_id AS row_id,
    event_type || CASE WHEN user_id % 2 = 0 THEN '_low' ELSE '' END AS task,
    ['similarity', 'random'][1 + {h("'s:' || event_id")} % 2] AS strategy,
    CASE WHEN {h("'y:' || event_id")} % 3 = 0 THEN ' YES ' ELSE 'No' END AS output,
    value,
    ['Yes', ' no.', 'YES indeed', 'None', 'maybe', '', NULL, chr(10)][1 + {h("'out:' || event_id")} % 8] AS model_output,
    ['12.5', 'about -3', '.5e-3', '1e-5', 'n/a', ''][1 + {h("'num:' || event_id")} % 6] AS number_output,
    ({h("'p:' || event_id")} % 101) / 100.0 AS p_yes,
    ({h("'n:' || event_id")} % 101) / 100.0 AS p_no,
    {h("'f:' || event_id")} % 11 = 0 AS failed
  FROM events)"""

YES_NO = """CASE WHEN starts_with(lower(regexp_replace(model_output, '^\\s+|\\s+$', '', 'g')), 'yes') THEN 1
      WHEN starts_with(lower(regexp_replace(model_output, '^\\s+|\\s+$', '', 'g')), 'no') THEN 0 END"""

JUDGED = f"""{PREDICTIONS},
parsed AS (
  SELECT *, CASE WHEN NOT failed THEN {YES_NO} END AS y, CASE WHEN NOT failed THEN p_yes::DOUBLE END AS u,
    CASE WHEN lower({strip('output')}) = 'yes' THEN 1 ELSE 0 END AS true_label,
    coalesce(nullif(regexp_extract(number_output, '[-+]?\\d*\\.?\\d+'), '')::DOUBLE, 0.0) AS predicted_value
  FROM predictions),
judged AS (
  SELECT *, coalesce(y, CASE WHEN u >= 0.5 THEN 1 WHEN u < 0.5 THEN 0 END, 0) AS predicted_label,
    coalesce(y::DOUBLE, u, 0.5) AS yes_prob FROM parsed)"""

CONVERSATIONS = """turns AS (
  SELECT u.conv_id * 1000 + u.turn AS row_id, u.text AS instruction, ' context ' AS input, a.text AS output
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

PARTS = """parts AS (
  SELECT p_partkey AS row_id, concat_ws(' ', p_name, p_type, p_brand) AS text, p_retailprice AS label
  FROM part)"""


def word_mask(text: str, draw: str) -> tuple[str, str]:
    """SQL of (masked, tag) with words that carry the blanks before them."""
    tokens = rf"regexp_extract_all({text}, '\s*\S+(\s+$)?')"
    at = f"({h(draw)} % len({tokens}))"
    short = f"coalesce(len({tokens}), 0) < 3"
    masked = (
        f"CASE WHEN {short} THEN {text} ELSE array_to_string(list_concat(list_concat("
        f"{tokens}[1:{at}], ['[MASK]']), {tokens}[{at} + 2:]), '') END"
    )
    tag = f"CASE WHEN {short} THEN 'Too_Short_To_Mask' ELSE 'BPE_Token:_' || {tokens}[{at} + 1] END"
    return masked, tag
