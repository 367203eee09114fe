"""Byte-pair tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Query, documents
from shotweave.functions.bytelevel import BYTE_CHARS
from shotweave.operators.bpe import (
    SPECIAL_TOKENS, bpe_decode, bpe_encode, bpe_train, initial_symbols, pair_counts, tokenizer_stats,
    word_counts,
)
from shotweave.plans.records import Masking
from shotweave.sources.tokenizers import load_tokenizer, save_tokenizer
from shotweave.storage import scratch_path

BASE = len(SPECIAL_TOKENS) + len(BYTE_CHARS)


def counted(spark, sf):
    return word_counts(documents(spark, sf), "text")


def _trained(spark, sf):
    return bpe_train(counted(spark, sf))


def _one_merge(spark, sf):
    """As far as SQL can follow."""
    return bpe_train(counted(spark, sf), BASE + 1)


def _saved(spark, tokenizer):
    path = scratch_path(spark, "tokenizer")
    save_tokenizer(tokenizer, spark, path)
    return load_tokenizer(spark, path).vocab_table(spark)


def first_pairs(spark, sf):
    return pair_counts(initial_symbols(counted(spark, sf)))


def learnt(spark, sf):
    """All merges of the default vocabulary."""
    return _trained(spark, sf).merges_table(spark)


def vocabulary(spark, sf):
    """Specials, bytes and the first merge, saved and loaded again."""
    return _saved(spark, _one_merge(spark, sf))


def full_vocabulary(spark, sf):
    """The default vocabulary, saved and loaded again."""
    return _saved(spark, _trained(spark, sf))


def encoded(spark, sf):
    rows = bpe_encode(documents(spark, sf), "text", _trained(spark, sf))
    return rows.select("row_id", F.array_join("ids", ",").alias("ids"))


def round_trip(spark, sf):
    tokenizer = _trained(spark, sf)
    rows = bpe_encode(documents(spark, sf), "text", tokenizer).select("row_id", "ids")
    return bpe_decode(rows, "ids", tokenizer, "text").select("row_id", "text")


def masked_tokens(spark, sf):
    masking = Masking.with_tokenizer(_trained(spark, sf))
    rows = documents(spark, sf).withColumn("tokens", masking.tokenise(F.col("text")))
    return rows.select("row_id", masking.apply(F.col("text"), F.col("row_id")).alias("masked"))


def sizes(spark, sf):
    return tokenizer_stats(_one_merge(spark, sf), spark)


def full_sizes(spark, sf):
    return tokenizer_stats(_trained(spark, sf), spark)


QUERIES: dict[str, Query] = {
    "word_counts": counted,
    "bpe_pair_counts": first_pairs,
    "bpe_merges": learnt,
    "tokenizer_vocab": vocabulary,
    "tokenizer_vocab_full": full_vocabulary,
    "bpe_encode": encoded,
    "bpe_roundtrip": round_trip,
    "mask_token_bpe": masked_tokens,
    "tokenizer_stats": sizes,
    "tokenizer_stats_full": full_sizes,
}

# RE2 has no lookahead: a break before the last blank of a run does the same.
_WORDS = r"""found AS (
  SELECT unnest(regexp_extract_all(regexp_replace(line || chr(10), '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g'),
    '''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')) AS word
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
words AS (SELECT word, count(*) AS n FROM found GROUP BY word)"""

_PRINTABLE = "(b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255)"
_PAIRS = f"""bytes AS (
  SELECT b, CASE WHEN {_PRINTABLE} THEN b ELSE 255 + row_number() OVER (PARTITION BY {_PRINTABLE} ORDER BY b) END AS code
  FROM range(256) AS r(b)),
alphabet AS (SELECT b, chr(code::INTEGER) AS c, (4 + row_number() OVER (ORDER BY code))::INTEGER AS id FROM bytes),
spelled AS (
  SELECT row_number() OVER () AS w, n, regexp_extract_all(hex(encode(word)), '..') AS hs FROM words),
symbols AS (
  SELECT w, n, i, id FROM (SELECT w, n, generate_subscripts(hs, 1) AS i, unnest(hs) AS x FROM spelled)
  JOIN alphabet ON b = ('0x' || x)::INTEGER),
pairs AS (
  SELECT a.id AS left, z.id AS right, sum(a.n)::BIGINT AS n
  FROM symbols a JOIN symbols z ON z.w = a.w AND z.i = a.i + 1 GROUP BY 1, 2),
top AS (SELECT * FROM pairs ORDER BY n DESC, "left", "right" LIMIT 1)"""

_SPECIAL = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL_TOKENS))

ORACLES: dict[str, str] = {
    "word_counts": f"WITH {_WORDS} SELECT word, n FROM words",
    "bpe_pair_counts": f'WITH {_WORDS}, {_PAIRS} SELECT "left", "right", n FROM pairs',
    "tokenizer_vocab": f"""WITH {_WORDS}, {_PAIRS}
      SELECT * FROM (VALUES {_SPECIAL}) AS s(token, id)
      UNION ALL SELECT c, id FROM alphabet
      UNION ALL SELECT a.c || z.c, {BASE} FROM top t JOIN alphabet a ON a.id = t."left" JOIN alphabet z ON z.id = t."right" """,
    "bpe_roundtrip": "SELECT doc_id AS row_id, text FROM documents",
    "tokenizer_stats": f"""WITH {_WORDS}, {_PAIRS}
      SELECT {BASE} + count(*) AS vocab_size, count(*) AS merges FROM top""",
}
