"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm import (
    byte_pairs, chunks, exact, language, lexicon, near, negatives, order_minhash, packing, quality,
    runs, shards, suffix,
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _digested(cut: DataFrame) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return cut.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op1_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    return _digested(suffix.remove_repeats(docs, "doc_id", "text", length=100))


def op2_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.edit_fingerprints(_documents(spark, sf), "doc_id", "text")


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_pairs.round_trip(_documents(spark, sf), "doc_id", "text")


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf), "doc_id", "text", keep="max")


def op5_gear_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    return _digested(chunks.remove_chunks(docs, "doc_id", "text"))


def op6_site_quality(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return quality.site_quality(_documents(spark, sf), labels, "doc_id", "text", "source", ["lang"])


def op7_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.balanced_shards(_documents(spark, sf), "doc_id", "text", shards=8)


def op8_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_documents(spark, sf), "doc_id", "text", capacity=1024)


def op9_chosen_path(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(_documents(spark, sf), "doc_id", "text")


def op10_gated_lm(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return language.log_likelihoods(_documents(spark, sf), "doc_id", "text", held_out)


def op11_word_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return lexicon.round_trip(docs, "doc_id", "text", lexicon.word_tokenizer(docs, "text"))


def op12_four_russians(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(rows, "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's input: a tenth of the texts, chosen by the id's checksum, made periodic."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    looped = F.expr(r"""
      transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8))))])""")
    found = docs.withColumn("h", checksum).withColumn("g", F.expr("h div 10")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    )
    found = found.withColumn("n", F.size("words").cast("bigint"))
    found = found.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    text = F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.collapse_runs(_with_periods(_documents(spark, sf).select("doc_id", "text")), "text", least=24, times=3)
    # By start, then period: the first of equal exponents stays.
    better = "r.length * best.period > best.length * r.period"
    best = F.expr(f"aggregate(runs, cast(named_struct('start', NULL, 'length', NULL, 'period', NULL) AS struct<start:bigint,length:bigint,period:bigint>), (best, r) -> if(best.period IS NULL OR {better}, r, best))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_order_minhash": op2_order_minhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_gear_chunks": op5_gear_chunks,
    "op6_site_quality": op6_site_quality,
    "op7_byte_shards": op7_byte_shards,
    "op8_best_fit": op8_best_fit,
    "op9_chosen_path": op9_chosen_path,
    "op10_gated_lm": op10_gated_lm,
    "op11_word_lexicon": op11_word_lexicon,
    "op12_four_russians": op12_four_russians,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op12_four_russians": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM scored WHERE same)
  WHERE n <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
WHERE rank <= 3""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
