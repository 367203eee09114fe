"""Byte-pair tokenizer: learn merges with Spark jobs, apply them, undo them."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.functions.bytelevel import (
    BYTE_CHARS,
    from_byte_level,
    split_units,
    split_words,
    to_byte_level,
)
from shotweave.functions.hashing import as_column
from shotweave.operators.bpe_rounds import _ragged, learn_in_rounds
from shotweave.operators.masking import MASK

# Fixed values.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>", "[MASK]"]
VOCAB_SIZE = 5000
MIN_FREQUENCY = 2


@dataclass(frozen=True)
class Tokenizer:
    """A trained model.  Its size is bounded by the vocabulary size asked for."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]

    @property
    def ids(self) -> dict[str, int]:
        return {token: i for i, token in enumerate(self.tokens)}

    def has(self, token: str) -> bool:
        return token in self.tokens

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(t, i) for i, t in enumerate(self.tokens)], "token string, id int"
        )

    def merges_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(r, a, b) for r, (a, b) in enumerate(self.merges)],
            "rank int, left string, right string",
        )

    def with_mask(self) -> Tokenizer:
        """The same model with the mask token, appended if it is missing."""
        return self if self.has(MASK) else Tokenizer((*self.tokens, MASK), self.merges)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over a corpus read line by line, line ends included.

    Blank-separated units are counted first, so only distinct ones are cut into words.
    """
    units = df.select(F.explode(split_units(F.col(text))).alias("unit"))
    counted = units.groupBy("unit").agg(F.count("*").alias("n"))
    found = counted.select(F.explode(split_words(F.col("unit"))).alias("word"), "n")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


# Words are kept as a string of symbol ids, ",12,,45,,7,", so that a merge is a
# plain left-to-right string replacement inside generated code.


def _as_symbols(word: Column, first_id: int) -> Column:
    ranks = {c: first_id + i for i, c in enumerate(sorted(BYTE_CHARS))}
    shown = F.split(to_byte_level(word), "")
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.concat(F.lit(","), F.array_join(F.transform(shown, lambda c: table[c]), ",,"), F.lit(","))


def _has_pairs() -> Column:
    return F.col("symbols").contains(",,")


def _ids(words: DataFrame) -> DataFrame:
    # A split on one character needs no regular expression.
    inner = F.expr("replace(substring(symbols, 2, length(symbols) - 2), ',,', ';')")
    return words.where(_has_pairs()).select(F.split(inner, ";").alias("s"), "n")


def initial_symbols(counts: DataFrame, first_id: int = len(SPECIAL_TOKENS)) -> DataFrame:
    """(symbols, n): counted words as their bytes."""
    return counts.select(_as_symbols(F.col("word"), first_id).alias("symbols"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) over all neighbouring symbols of counted words."""
    pairs = F.expr(
        "transform(sequence(0, size(s) - 2), i -> named_struct('left', s[i], 'right', s[i + 1]))"
    )
    return (
        _ids(words)
        .select(F.explode(pairs).alias("p"), "n")
        .groupBy("p.left", "p.right")
        .agg(F.sum("n").alias("n"))
        .select(F.col("left").cast("int"), F.col("right").cast("int"), "n")
    )


def bpe_train(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    special_tokens: list[str] | None = None,
) -> Tokenizer:
    """Learn merges from (word, n).

    The most frequent neighbouring pair is merged until the vocabulary is
    full or no pair reaches ``min_frequency``; ties go to the smaller ids.  The
    words stay on the cluster, see :mod:`shotweave.operators.bpe_rounds`; the
    result is that of one merge at a time over all of them.
    """
    special = SPECIAL_TOKENS if special_tokens is None else special_tokens
    tokens = [*special, *sorted(BYTE_CHARS)]
    first = {c: len(special) + i for i, c in enumerate(sorted(BYTE_CHARS))}
    merges = learn_in_rounds(
        counts, np.array([first[c] for c in BYTE_CHARS], np.int32), tokens, vocab_size, min_frequency
    )
    return Tokenizer(tuple(tokens), tuple(merges))


#: Bytes from which a word is merged by itself, in n log n.
LONG = 64
#: Such words whose ids a worker remembers; beyond that it starts again.
REMEMBERED = 10_000
#: Words of a batch that are laid out at once; a longer text is taken whole.
WORDS_AT_ONCE = 1 << 18


def merge_symbols(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equal ones, as long as there is one.

    ``pairs`` has the rank and the result of each.  A linked line of symbols and a
    heap of ranks: n log n, however long the word is.
    """
    n = len(symbols)
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    current: dict[int, tuple[int, int]] = {}
    heap: list[tuple[int, int]] = []
    for i in range(n - 1):
        found = pairs.get((ids[i], ids[i + 1]))
        if found:
            current[i] = found
            heap.append((found[0], i))
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if i not in current or current[i][0] != rank:
            continue
        gone = after[i]
        ids[i], ids[gone], after[i] = current[i][1], -1, after[gone]
        current.pop(gone, None)
        if after[i] < n:
            before[after[i]] = i
        for left in (i, before[i]):
            current.pop(left, None)
            if left >= 0 and after[left] < n:
                found = pairs.get((ids[left], ids[after[left]]))
                if found:
                    current[left] = found
                    heapq.heappush(heap, (found[0], left))
    return [x for x in ids if x >= 0]


def merge_words(
    symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``merge_symbols`` of many words side by side, one merge of each at a time.

    ``keys`` are the pairs as one number, ascending, with their ``ranks``; ``results``
    has what each rank gives.  No word is empty.  Returns the ids and their number by word.
    """
    none = np.int64(len(results))

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        return np.where(keys[place] == pair, ranks[place], none) if len(keys) else np.full(len(pair), none)

    sym, lengths, word = symbols.astype(np.int32), lengths.astype(np.int64), np.arange(len(lengths))
    # Equal pairs are looked up once: at first there are few.
    pair, which = np.unique(sym[:-1].astype(np.int64) << 32 | sym[1:], return_inverse=True)
    rank = np.append(rank_of(pair >> 32, pair & 0xFFFFFFFF)[which], none)
    starts = np.cumsum(lengths) - lengths
    rank[starts + lengths - 1] = none
    finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(word):
        best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
        busy = best >> 32 < none
        if not busy.all():
            # Words without a pair are laid aside.
            of_busy = np.repeat(busy, lengths)
            finished.append((word[~busy], lengths[~busy], sym[~of_busy]))
            moved = np.cumsum(of_busy) - 1
            best = best[busy]
            at = moved[best & 0xFFFFFFFF]
            sym, rank, word, lengths = sym[of_busy], rank[of_busy], word[busy], lengths[busy]
            starts = np.cumsum(lengths) - lengths
        else:
            at = best & 0xFFFFFFFF
        sym[at] = results[best >> 32]
        last = starts + lengths - 1
        inner, begun = at + 1 < last, at > starts
        rank[at] = none
        rank[at[inner]] = rank_of(sym[at[inner]], sym[at[inner] + 2])
        rank[at[begun] - 1] = rank_of(sym[at[begun] - 1], sym[at[begun]])
        left = np.ones(len(sym), bool)
        left[at + 1] = False
        sym, rank, lengths = sym[left], rank[left], lengths - 1
        starts = np.cumsum(lengths) - lengths
    word, lengths, sym = (np.concatenate(x) for x in zip(*finished)) if finished else (word, lengths, sym)
    order = np.argsort(word)
    return sym[_ragged((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]


class _WordEncoder:
    """Ids of words; each distinct word of a batch is merged once."""

    def __init__(self, tokens: tuple[str, ...], merges: tuple[tuple[str, str], ...]) -> None:
        ids = {token: i for i, token in enumerate(tokens)}
        self.first = np.array([ids[c] for c in BYTE_CHARS], np.int32)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.pairs[ids[left], ids[right]] = rank, ids[left + right]
        ranked = sorted((left << 32 | right, rank) for (left, right), (rank, _) in self.pairs.items())
        self.keys, self.ranks = (np.array([x[i] for x in ranked], np.int64) for i in (0, 1))
        self.results = np.array([ids[left + right] for left, right in merges], np.int32)
        self.tokens = pa.array(tokens, pa.string())
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        """Ids of a long word; those met are remembered."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = np.array(merge_symbols(self.first[list(word.encode())].tolist(), self.pairs), np.int32)
            self.known[word] = found
        return found

    def distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some words, and where each word's begin and how many they are."""
        column = words.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        bytes_of = np.diff(offsets)
        sizes = np.zeros(len(words), np.int64)
        short = np.flatnonzero((bytes_of > 0) & (bytes_of <= LONG))
        found, sizes[short] = merge_words(
            self.first[raw[_ragged(offsets[short], bytes_of[short])]], bytes_of[short], self.keys, self.ranks, self.results
        )
        starts = np.zeros(len(words), np.int64)
        starts[short] = np.cumsum(sizes[short]) - sizes[short]
        parts, at = [found], len(found)
        for i in np.flatnonzero(bytes_of > LONG).tolist():
            parts.append(self.word(words[i].as_py()))
            starts[i], sizes[i] = at, len(parts[-1])
            at += len(parts[-1])
        return np.concatenate(parts), starts, sizes

    def ids(self, words: pa.ListArray) -> pa.ListArray:
        flat = words.flatten().dictionary_encode()
        found, starts, sizes = self.distinct(flat.dictionary)
        which = np.asarray(flat.indices)
        lengths = sizes[which]
        rows = np.append(0, np.cumsum(np.asarray(words.value_lengths())))
        return pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(lengths))[rows], pa.int32()), pa.array(found[_ragged(starts[which], lengths)], pa.int32())
        )

    def shown(self, ids: pa.ListArray) -> pa.ListArray:
        return pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))

    def __call__(self, words: pa.ListArray, wanted: str) -> pa.Array:
        """Ids, tokens or both of a batch, ``WORDS_AT_ONCE`` words of it at a time."""
        ends, done = np.cumsum(np.asarray(words.value_lengths())), []
        first = 0
        while first < len(words) or not done:
            base = ends[first - 1] if first else 0
            stop = max(int(np.searchsorted(ends, base + WORDS_AT_ONCE, "right")), first + 1)
            ids = self.ids(words[first:stop])
            done.append(ids if wanted == "ids" else self.shown(ids) if wanted == "tokens" else pa.StructArray.from_arrays([self.shown(ids), ids], ["tokens", "ids"]))
            first = stop
        return pa.concat_arrays(done)


@lru_cache(maxsize=4)
def _encoder(tokens: tuple[str, ...], merges: tuple[tuple[str, str], ...]) -> _WordEncoder:
    return _WordEncoder(tokens, merges)


_WANTED = {"ids": "array<int>", "tokens": "array<string>", "both": "struct<tokens:array<string>,ids:array<int>>"}


def _encode(text, tokenizer: Tokenizer, wanted: str) -> Column:
    tokens, merges = tokenizer.tokens, tokenizer.merges

    @F.arrow_udf(_WANTED[wanted])
    def encode(words: pa.Array) -> pa.Array:
        return _encoder(tokens, merges)(words, wanted)

    words = F.coalesce(split_words(text), F.array().cast("array<string>"))
    return F.when(as_column(text).isNotNull(), encode(words))


def bpe_encoded(text, tokenizer: Tokenizer) -> Column:
    """Tokens and ids of a text, as a struct of two arrays; NULL of NULL.

    Splitting stays in the JVM.  One pass through Arrow takes a batch of words,
    merges those it has not met before and lays out both arrays from the positions
    of distinct words.  No shuffle.
    """
    return _encode(text, tokenizer, "both")


def bpe_ids(text, tokenizer: Tokenizer) -> Column:
    """Ids of a text; tokens are not laid out."""
    return _encode(text, tokenizer, "ids")


def bpe_tokens(text, tokenizer: Tokenizer) -> Column:
    """Tokens of a text; ids are not sent back."""
    return _encode(text, tokenizer, "tokens")


def _tokens_of(ids: Column, tokenizer: Tokenizer) -> Column:
    """Tokens of an id array, looked up in the JVM; an id that is none is an error."""
    table = F.from_json(F.lit(json.dumps(tokenizer.tokens)), "array<string>")
    unknown = F.raise_error(F.lit("an id outside the vocabulary"))
    return F.transform(ids, lambda i: F.coalesce(F.get(table, i), unknown))


def bpe_encode(df: DataFrame, text: str, tokenizer: Tokenizer) -> DataFrame:
    """Add ``tokens`` and ``ids`` of a text column; tokens are looked up by id, where they are used."""
    return df.withColumn("ids", bpe_ids(F.col(text), tokenizer)).select(
        *[c for c in df.columns if c not in ("tokens", "ids")], _tokens_of(F.col("ids"), tokenizer).alias("tokens"), "ids"
    )


def bpe_join(tokens) -> Column:
    """Text of a token array."""
    return from_byte_level(F.array_join(tokens, ""))


def bpe_decode(df: DataFrame, ids: str, tokenizer: Tokenizer, name: str = "decoded") -> DataFrame:
    """Add the text of an id array; the mask token is kept, not dropped."""
    return df.withColumn(name, bpe_join(_tokens_of(F.col(ids), tokenizer)))


def tokenizer_stats(tokenizer: Tokenizer, spark: SparkSession) -> DataFrame:
    """Sizes of a model."""
    return spark.range(1).select(
        F.lit(len(tokenizer.tokens)).cast("bigint").alias("vocab_size"),
        F.lit(len(tokenizer.merges)).cast("bigint").alias("merges"),
    )
