"""Word-end BPE with a minimal acyclic transducer of the corpus' frequent words.

The words of all documents are counted; the frequent ones, with the ids they
encode to, are compiled into the smallest acyclic automaton.  It shares suffixes
as well as prefixes, so a word's ids cannot hang on its last state; instead every
arc says how many words come before it, their sum along a path is the number of
the word, and the number leads to the ids.  Model and lexicon are two files of
plain arrays that every executor fetches once and its workers map into memory.
All words of a block walk the automaton side by side.  Words that it does not
have are merged, lowest rank first and leftmost of equal ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from shotweave.llm.arrays import binary_array, blocks, columns, from_columns, ragged, text_buffer
from shotweave.llm.pieces import code_points
from shotweave.llm.runs import word_numbers
from shotweave.storage import materialise, scratch_path

#: Words in the automaton at most, and bytes of the longest of them.
WORDS = 1 << 17
WORD_BYTES = 64
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Marks a code point whose lower case is more than one.
_SEVERAL = 0xFFFFFFFF
_NONE = np.int32(np.iinfo(np.int32).max)
#: Below this no code point composes with another.
_COMPOSING = 0x300
#: Longest word that is merged beside others.
LANE = 64


# --- arrays in files -----------------------------------------------------------


def _publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes into the shared folder; Spark brings the file to every executor."""
    label = f"{name}-{uuid.uuid4().hex}"
    path = scratch_path(spark, label)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


@lru_cache(maxsize=8)
def _mapped(name: str) -> list[np.ndarray]:
    """The arrays of a published file; all workers of a machine share its pages."""
    with open(SparkFiles.get(name), "rb") as file:
        return from_columns(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


@dataclass(frozen=True)
class Table:
    """From keys to positions: open addressing in two arrays."""

    slots: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        size = 1 << max(2 * len(keys), 2).bit_length()
        slots, found = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        at = _slot(keys, size)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            free = first[slots[at[first]] == -1]
            slots[at[free]], found[at[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)
        return cls(slots, found)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = _slot(keys, len(self.slots))
        found = self.slots[at]
        miss = np.flatnonzero((found != keys) & (found != -1))
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self.slots) - 1)
            again = self.slots[at[miss]]
            found[miss] = again
            miss = miss[(again != keys[miss]) & (again != -1)]
        return np.where(found == keys, self.values[at], np.int32(-1))


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    shift = np.uint64(64 - size.bit_length() + 1)
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


# --- model ---------------------------------------------------------------------


def _text_tables(model: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point, as the library itself has them."""
    kinds = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    lowercase = normalizers.Lowercase()
    marks = [(kind, normalizers.Replace(Regex(p), "a")) for kind, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
    for begin in range(0, 0x110000, 0x800):
        if begin == 0xD800:  # surrogates
            continue
        text = "".join(map(chr, range(begin, begin + 0x800)))
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for kind, mark in marks:
            shown = np.frombuffer(mark.normalize_str(text).encode("utf-32-le"), np.uint32)
            kinds[begin : begin + 0x800][shown != own] = kind
        small = lowercase.normalize_str(text)
        if len(small) == len(text):
            lower[begin : begin + 0x800] = np.frombuffer(small.encode("utf-32-le"), np.uint32)
        else:
            each = [lowercase.normalize_str(c) for c in text]
            lower[begin : begin + 0x800] = [ord(c) if len(c) == 1 else _SEVERAL for c in each]
    kinds[ord("a")] = LETTER  # written over itself
    return kinds, lower


@lru_cache(maxsize=2)
def _model_file(path: str) -> bytes:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    shown = {**{i: t for t, i in vocabulary.items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
    spelled = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
    alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    # How the library shows each byte: by code points whose UTF-8 has it.
    byte_chars: dict[int, str] = {}
    for point in [*range(0x100), *range(0x100, 0x800, 0x40), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000)]:
        if 0xD800 <= point < 0xE000:
            continue
        raw = chr(point).encode()
        byte_chars.update(zip(raw, alphabet.pre_tokenize_str(chr(point))[0][0], strict=True))
    single = np.array([[vocabulary[byte_chars.get(b, chr(b)) + end] if b in byte_chars else 0 for end in ("", suffix)] for b in range(256)], np.int32)
    pairs = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], np.int64)
    made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
    pairs, first = np.unique(pairs[::-1], return_index=True)  # of a pair given twice, the library keeps the last
    ranks = Table.of(pairs, (len(merges) - 1 - first).astype(np.int32))
    kinds, lower = _text_tables(Tokenizer.from_file(path))
    special = np.frombuffer(
        json.dumps({t["content"]: t["id"] for t in spec["added_tokens"]}).encode(), np.uint8
    )
    return columns(
        kinds, lower, single, ranks.slots, ranks.values, made,
        np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)]), special,
    )


class Model:
    """The tables of a vocabulary, as arrays of a file."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.kinds, self.lower, single, slots, values, self.made, self.spelled, self.spelled_at, special = arrays
        self.single = single.reshape(256, 2)
        self.ranks = Table(slots, values)
        self.special: dict[str, int] = json.loads(special.tobytes())

    # How texts become words.

    def _plain(self, text: str) -> str:
        """Composed, and lower case where that is more than one code point."""
        composed = text
        if not unicodedata.is_normalized("NFC", text) or any(map(unicodedata.combining, set(text))):
            composed = normalizers.NFC().normalize_str(text)  # its classes of marks are older than Python's
        several = {c for c in set(composed) if self.lower[ord(c)] == _SEVERAL}
        return composed.translate({ord(c): normalizers.Lowercase().normalize_str(c) for c in several})

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lower-case UTF-8 of a block of texts, where its words begin and end, and
        the first word of each text (n + 1)."""
        points, at = code_points(raw, offsets)
        unusual = np.flatnonzero((points >= _COMPOSING) | (self.lower[points] == _SEVERAL))
        rows = np.unique(np.searchsorted(at, unusual, "right") - 1)
        if len(rows):
            changed = {}
            for row in rows.tolist():
                text = points[at[row] : at[row + 1]].tobytes().decode("utf-32-le")
                plain = self._plain(text)
                if plain != text:
                    changed[row] = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
            if changed:
                parts = [changed.get(row, points[a:b]) for row, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
                points, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        points = self.lower[points]
        n, kind = len(points), self.kinds[points]
        border = np.zeros(n + 1, bool)
        border[at] = True
        start = border[:-1] | (kind == NUMBER)
        start[1:] |= kind[1:] != kind[:-1]
        start &= kind != SPACE
        # An apostrophe that begins a word may be a short ending of what came before.
        quote = np.flatnonzero(start & (points == 39))
        if len(quote):
            padded = np.append(points, np.zeros(2, np.uint32))
            end = at[np.searchsorted(at, quote, "right")]
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < end)
            long = (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))) & (quote + 2 < end)
            start[quote[short | long] + 1] = False
            for chosen, size in ((short, 2), (long, 3)):
                rest = quote[chosen] + size
                rest = rest[rest < end[chosen]]
                start[rest[kind[rest] == LETTER]] = True
        cuts = np.flatnonzero(start | (kind == SPACE) | border[:-1])
        is_word = start[cuts]
        starts, ends = cuts[is_word], np.append(cuts[1:], n)[is_word]
        firsts = np.searchsorted(starts, at)
        if n and points.max() >= 128:
            width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
            place = np.append(0, np.cumsum(width))
            data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
            return data, place[starts], place[ends], firsts
        return points.astype(np.uint8), starts, ends, firsts

    # How words become ids.

    def merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words side by side, and the number of ids of each."""
        lengths = ends - starts
        counts = np.zeros(len(starts), np.int64)
        found = []
        shorter, wide = 0, 4
        while wide <= LANE:
            rows = np.flatnonzero((lengths > shorter) & (lengths <= wide))
            for part in np.array_split(rows, max(1, len(rows) * wide // (1 << 20))):
                if len(part):
                    ids, counts[part] = self._merge_lanes(raw, starts[part], lengths[part], wide)
                    found.append((part, ids))
            shorter, wide = wide, wide * 2
        for row in np.flatnonzero(lengths > LANE):
            ids = self._merge_long(raw[starts[row] : ends[row]])
            counts[row] = len(ids)
            found.append((np.array([row]), ids))
        out = np.zeros(int(counts.sum()), np.int32)
        begins = np.cumsum(counts) - counts
        for part, ids in found:
            out[ragged(begins[part], counts[part])] = ids
        return out, counts

    def _symbols(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.where(last, self.single[raw, 1], self.single[raw, 0])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.find((left.astype(np.int64) << 32) | right)
        return np.where(found < 0, _NONE, found)

    def _merge_lanes(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """One word a row: the best pair of each row is merged and the rest moves up."""
        n, column = len(starts), np.arange(wide)
        ids = np.full((n, wide), -1, np.int32)
        inside = column < lengths[:, None]
        ids[inside] = self._symbols(raw[ragged(starts, lengths)], (column == lengths[:, None] - 1)[inside])
        rank = np.full((n, wide), _NONE, np.int32)
        row, col = np.nonzero(inside[:, 1:])
        rank[row, col] = self._rank(ids[row, col], ids[row, col + 1])
        left = lengths.copy()
        live = np.arange(n)
        done = np.full((n, wide), -1, np.int32)
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            more = best < _NONE
            done[live[~more]] = ids[~more]
            live, ids, rank, at, best = live[more], ids[more], rank[more], at[more], best[more]
            if not len(live):
                break
            left[live] -= 1
            # The symbol after the pair's first goes; later ones move up by one.
            after = column > at[:, None]
            moved = np.minimum(column + after, wide - 1)
            ids, rank = np.take_along_axis(ids, moved, 1), np.take_along_axis(rank, moved, 1)
            each = np.arange(len(live))
            ids[:, -1], rank[:, -1] = -1, _NONE
            ids[each, at] = self.made[best]
            size = left[live]
            rank[each, at] = _NONE
            follows = at + 1 < size
            rank[each[follows], at[follows]] = self._rank(ids[each[follows], at[follows]], ids[each[follows], at[follows] + 1])
            before = at > 0
            rank[each[before], at[before] - 1] = self._rank(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        return done[done >= 0], left

    def _merge_long(self, word: np.ndarray) -> np.ndarray:
        """One long word: a linked line of symbols and a heap of pairs."""
        n = len(word)
        start = self._symbols(word, np.arange(n) == n - 1)
        ids, after, before = start.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
        first = self._rank(start[:-1], start[1:])
        heap = [(int(first[i]), i) for i in np.flatnonzero(first < _NONE).tolist()]
        current = {i: r for r, i in heap}
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def look(i: int) -> None:
            current.pop(i, None)
            if after[i] >= 0:
                pair = ids[i], ids[after[i]]
                if pair not in known:
                    known[pair] = int(self._rank(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] < _NONE:
                    current[i] = known[pair]
                    heapq.heappush(heap, (known[pair], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if current.get(i) != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.made[rank]), -1, after[gone]
            current.pop(gone, None)
            if after[i] >= 0:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens as shown, each with a blank behind it, and n + 1 offsets of sequences."""
        lengths = np.diff(self.spelled_at)[ids]
        running = np.append(0, np.cumsum(lengths))
        return self.spelled[ragged(self.spelled_at[ids], lengths)], running[offsets]


# --- automaton -----------------------------------------------------------------


def compile_words(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """The minimal automaton of sorted distinct words.

    Returns arc keys (state * 256 + byte), targets, how many words an arc skips,
    and which states end a word.  State 0 is the start.  States are made once all
    words through them are known, and equal ones are made once.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    reach: list[int] = []

    def freeze(node: list) -> int:
        signature = (node[0], *node[1])
        if signature not in register:
            register[signature] = len(states)
            states.append(signature)
            reach.append(node[0] + sum(reach[target] for _, target in node[1]))
        return register[signature]

    path, last = [[False, []]], b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        while len(path) > shared + 1:
            target = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        target = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], target))
    start = freeze(path[0])
    number = lambda state: 0 if state == start else state + 1
    keys, targets, skips, ends = [], [], [], np.zeros(len(states) + 1, bool)
    for state, (ends_word, *arcs) in enumerate(states):
        ends[number(state)] = ends_word
        skipped = int(ends_word)
        for byte, target in arcs:
            keys.append(number(state) << 8 | byte)
            targets.append(number(target))
            skips.append(skipped)
            skipped += reach[target]
    return np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), ends


class Lexicon:
    """The automaton and the ids of its words, as arrays of a file."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        slots, values, self.targets, self.skips, ends, self.ids, self.ids_at = arrays
        self.arcs, self.ends = Table(slots, values), ends.astype(bool)

    @staticmethod
    def file(words: list[bytes], model: Model) -> bytes:
        keys, targets, skips, ends = compile_words(words)
        arcs = Table.of(keys, np.arange(len(keys), dtype=np.int32))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(sizes)
        ids, counts = model.merge(np.frombuffer(b"".join(words), np.uint8), stop - sizes, stop)
        return columns(
            arcs.slots, arcs.values, targets, skips, ends.astype(np.uint8), ids, np.append(0, np.cumsum(counts))
        )

    def number(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in the lexicon, -1 where it is not in it."""
        found = np.full(len(starts), -1, np.int64)
        live, at, stop = np.arange(len(starts)), starts, ends
        state, number = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(live):
            arc = self.arcs.find(state << 8 | raw[at])
            known = arc >= 0
            live, at, stop, arc = live[known], at[known] + 1, stop[known], arc[known]
            state, number = self.targets[arc].astype(np.int64), number[known] + self.skips[arc]
            over = at == stop
            ending = over & self.ends[state]
            found[live[ending]] = number[ending]
            live, at, stop, state, number = live[~over], at[~over], stop[~over], state[~over], number[~over]
        return found


class Encoder:
    """Ids of blocks of texts."""

    def __init__(self, model: Model, lexicon: Lexicon) -> None:
        self.model, self.lexicon = model, lexicon

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and n + 1 offsets into them."""
        data = raw.tobytes()
        if not any(token.encode() in data for token in self.model.special):
            return self._plain(raw, offsets)
        # The strings of special tokens cut a text before anything else happens.
        texts = [data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        cuts = [self._cut(text) for text in texts]
        parts = [part if isinstance(part, str) else "" for cut in cuts for part in cut]
        ids, at = self._plain(*text_buffer(pa.array(parts, pa.large_string())))
        out, ends, k = [], [0], 0
        for cut in cuts:
            for part in cut:
                out.append(ids[at[k] : at[k + 1]] if isinstance(part, str) else np.array([part], np.int32))
                k += 1
            ends.append(ends[-1] + sum(map(len, out[len(out) - len(cut) :])))
        return np.concatenate(out), np.array(ends)

    def _cut(self, text: str) -> list[str | int]:
        """Stretches of ordinary text and ids of special tokens, the longest at each place."""
        out, begin, tokens = [], 0, sorted(self.model.special, key=len, reverse=True)
        while True:
            places = [(p, i) for i, t in enumerate(tokens) if (p := text.find(t, begin)) >= 0]
            if not places:
                return [*out, text[begin:]]
            place, which = min(places)
            out += [text[begin:place], self.model.special[tokens[which]]]
            begin = place + len(tokens[which])

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, firsts = self.model.words(raw, offsets)
        number = self.lexicon.number(data, starts, ends)
        begins, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        known = number >= 0
        begins[known] = self.lexicon.ids_at[number[known]]
        counts[known] = self.lexicon.ids_at[number[known] + 1] - begins[known]
        new = np.flatnonzero(~known)
        same = word_numbers(data, starts[new], ends[new])
        _, one, place = np.unique(same, return_index=True, return_inverse=True)
        merged, sizes = self.model.merge(data, starts[new[one]], ends[new[one]])
        begins[new], counts[new] = (np.cumsum(sizes) - sizes)[place], sizes[place]
        running = np.append(0, np.cumsum(counts))
        ids = np.empty(int(running[-1]), np.int32)
        for words, source in ((np.flatnonzero(known), self.lexicon.ids), (new, merged)):
            ids[ragged(running[words], counts[words])] = source[ragged(begins[words], counts[words])]
        return ids, running[firsts]


# --- Spark ---------------------------------------------------------------------


@dataclass(frozen=True)
class WordTokenizer:
    """Names of the two published files."""

    model: str
    lexicon: str

    def encoder(self) -> Encoder:
        return _encoder(self.model, self.lexicon)


@lru_cache(maxsize=2)
def _encoder(model: str, lexicon: str) -> Encoder:
    return Encoder(Model(_mapped(model)), Lexicon(_mapped(lexicon)))


_PUBLISHED: dict[tuple[str, str], str] = {}


def _model(spark: SparkSession, path: str) -> str:
    """The published tables of a vocabulary, once for each application."""
    key = spark.sparkContext.applicationId, path
    if key not in _PUBLISHED:
        _PUBLISHED[key] = _publish(spark, "word-model", _model_file(path))
    return _PUBLISHED[key]


def count_words(df: DataFrame, text: str, model: str) -> DataFrame:
    """(word, n): the words of all texts as the vocabulary cuts them, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Model(_mapped(model))
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for a, b in blocks(offsets):
                data, starts, ends, _ = tables.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                short = ends - starts <= WORD_BYTES
                starts, ends = starts[short], ends[short]
                _, one, n = np.unique(word_numbers(data, starts, ends), return_index=True, return_counts=True)
                lengths = ends[one] - starts[one]
                words = binary_array(data[ragged(starts[one], lengths)], np.append(0, np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    counted = df.select(df[text].alias("text")).mapInArrow(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def word_tokenizer(df: DataFrame, text: str, path: str | None = None, words: int = WORDS) -> WordTokenizer:
    """Count the words of all texts and compile the most frequent ones, at most ``words``.

    The choice of words changes the speed only, never the ids.  Counts fall into
    sixteen classes per doubling; the largest number of whole classes that fits is
    taken, so nothing is sorted and at most ``words`` words reach the task that
    compiles.  An empty table gives an empty lexicon.  The two files are bounded
    by the vocabulary and by ``words``.
    """
    spark = df.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    model = _model(spark, path)
    counted = materialise(count_words(df, text, model).where("n > 1"), "words")
    level = F.floor(F.log2("n") * 16)
    left, least = words, 0
    for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        left -= row["n"]
        if left < 0:
            least = row["level"] + 1
            break

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted(word for batch in batches for word in batch.column(0).to_pylist())
        data = Lexicon.file(known, Model(_mapped(model)))
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    # Bounded by ``words``, so one task can hold them.
    chosen = counted.where(level >= least).select("word").repartition(1)
    data = chosen.mapInArrow(compiled, "data binary").collect()
    if not data:
        return WordTokenizer(model, _publish(spark, "lexicon", Lexicon.file([], Model(from_columns(_model_file(path))))))
    return WordTokenizer(model, _publish(spark, "lexicon", bytes(data[0]["data"])))


def encode(df: DataFrame, text: str, tokenizer: WordTokenizer, ids: str = "ids") -> DataFrame:
    """Add the ids of a whole text as ARRAY<INT>; null and blank texts give [].

    The strings of special tokens in a text become their ids.  Needs no shuffle.
    Texts are taken together up to 2 MB, a longer one alone.  Other columns pass
    unchanged; one that already has the name of the new one is replaced.
    """
    df = df.drop(ids) if ids in df.columns and ids != text else df
    rest = [f for f in df.schema.fields if f.name != ids]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, at in _encoded(batches, text, tokenizer):
            column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))
            kept = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, column], names=[*[f.name for f in rest], ids])

    return df.mapInArrow(run, schema)


def _encoded(
    batches: Iterator[pa.RecordBatch], text: str, tokenizer: WordTokenizer
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with the ids of their texts."""
    encoder = tokenizer.encoder()
    for batch in batches:
        raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        for a, b in blocks(offsets):
            yield batch.slice(a, b - a), *encoder(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def decode(df: DataFrame, ids: str, tokenizer: WordTokenizer, decoded: str = "decoded") -> DataFrame:
    """Add the text of ARRAY<INT> ids: tokens as the vocabulary shows them, by single blanks.

    That is what the library gives for a vocabulary without a decoder.  Null and []
    give ''.  A column that already has the name of the new one is replaced.
    """
    df = df.drop(decoded) if decoded in df.columns and decoded != ids else df
    rest = [f for f in df.schema.fields if f.name != decoded]
    schema = T.StructType([*rest, T.StructField(decoded, T.StringType())])
    model = tokenizer.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Model(_mapped(model))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            at = np.append(0, np.cumsum(np.asarray(column.value_lengths().fill_null(0))))
            data, ends = tables.decoded(np.asarray(column.flatten()), at)
            texts = [data[a : max(a, b - 1)].tobytes().decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            kept = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*[f.name for f in rest], decoded])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, doc_id: str, text: str, tokenizer: WordTokenizer) -> DataFrame:
    """Digests of the ids of every text and of the text they decode to.

    Columns doc_id, n_tokens, ids_sha256, decoded_sha256: ids are hashed as
    little-endian unsigned 32-bit integers.  Null counts as empty, repeated rows
    give repeated results, an empty table gives none, other columns do not matter.
    One pass in which ids never leave the worker; texts as in ``encode``.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
         T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = Model(_mapped(tokenizer.model)).decoded
        for batch, ids, at in _encoded(batches, "text", tokenizer):
            data, ends = decoded(ids, at)
            words, shown = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
            cut, end = at.tolist(), ends.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(words[4 * x : 4 * y]).hexdigest() for x, y in zip(cut, cut[1:])], pa.string()),
                    pa.array([hashlib.sha256(shown[x : max(x, y - 1)]).hexdigest() for x, y in zip(end, end[1:])], pa.string()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
