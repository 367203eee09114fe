"""Tokenizer models as tables or as the usual pair of files."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from shotweave.operators.bpe import Tokenizer
from shotweave.storage import write_file

# File names and format.
VOCAB_FILE, MERGES_FILE = "vocab.json", "merges.txt"
MERGES_HEADER = "#version: 0.2"


def save_tokenizer(tokenizer: Tokenizer, spark: SparkSession, path: str) -> None:
    """Two small Parquet tables, ``vocab`` and ``merges``."""
    base = path.rstrip("/")
    tokenizer.vocab_table(spark).coalesce(1).write.parquet(f"{base}/vocab")
    tokenizer.merges_table(spark).coalesce(1).write.parquet(f"{base}/merges")


def save_tokenizer_files(tokenizer: Tokenizer, spark: SparkSession, path: str) -> None:
    """``vocab.json`` and ``merges.txt``, two plain files that other tools open."""
    base = path.rstrip("/")
    vocab = json.dumps(tokenizer.ids, ensure_ascii=False)
    merges = "\n".join([MERGES_HEADER, *[f"{a} {b}" for a, b in tokenizer.merges]])
    for name, text in ((VOCAB_FILE, vocab), (MERGES_FILE, merges)):
        write_file(spark, f"{base}/{name}", text + ("\n" if name == MERGES_FILE else ""))


def _missing(path: str) -> FileNotFoundError:
    return FileNotFoundError(f"tokenizer files not found below {path}")


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """A saved model, whichever form; both parts must exist.

    The mask token is appended if the vocabulary lacks it.  A model is bounded
    by its vocabulary size, so it is held on the driver.
    """
    base = path.rstrip("/")
    try:
        vocab = spark.read.parquet(f"{base}/vocab")
        merges = spark.read.parquet(f"{base}/merges")
    except AnalysisException:
        return _load_files(spark, base)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    pairs = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    return Tokenizer(_in_order(ids, base), tuple(pairs)).with_mask()


def _in_order(ids: dict[str, int], base: str) -> tuple[str, ...]:
    """Tokens by id; ids that are not 0, 1, 2, ... would change silently."""
    if sorted(ids.values()) != list(range(len(ids))):
        raise ValueError(f"token ids below {base} are not 0 to {len(ids) - 1} without gaps")
    return tuple(sorted(ids, key=ids.get))


def _load_files(spark: SparkSession, base: str) -> Tokenizer:
    try:
        texts = [
            spark.read.text(f"{base}/{name}", wholetext=True).first()["value"]
            for name in (VOCAB_FILE, MERGES_FILE)
        ]
    except AnalysisException as error:
        raise _missing(base) from error
    ids = json.loads(texts[0])
    lines = [line for line in texts[1].split("\n") if line and not line.startswith("#version")]
    pairs = [tuple(line.split(" ")) for line in lines]
    return Tokenizer(_in_order(ids, base), tuple(pairs)).with_mask()
