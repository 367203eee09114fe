"""Tokenizer, packing and language model against the public libraries and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotweave.llm import arrays, byte_pairs, language, packing, pieces
from tests.llm.conftest import table

RANKS = byte_pairs.load_ranks()
PUBLIC = tiktoken.Encoding(
    "public", pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={t: i for i, t in enumerate(RANKS.tokens) if t}, special_tokens={},
)
PATTERN = regex.compile(public_tokenizers.PATTERN)


def split(texts):
    raw, offsets = arrays.text_buffer(pa.array(texts, pa.string()))
    points, at = pieces.code_points(raw, offsets)
    starts = pieces.piece_starts(points, at)
    ends = np.append(starts[1:], len(points)).astype(int)
    whole = "".join(t or "" for t in texts)
    cut = np.searchsorted(starts, at)
    return [[whole[starts[i] : ends[i]] for i in range(a, b)] for a, b in zip(cut, cut[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strevlmdSa1é中²!.\u0085\x1c‍\U0001f468"), st.characters(codec="utf-8")))))
def test_pieces_are_the_matches_of_the_pattern(texts):
    assert split(texts) == [PATTERN.findall(t) for t in texts]


def encode(texts):
    ids, at = pieces.PieceEncoder(byte_pairs.SegmentTreeEncoder(RANKS))(*arrays.text_buffer(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aeinorst é'1 .\n", max_size=200), max_size=5))
def test_ids_are_those_of_the_public_library(texts):
    assert encode(texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_long_pieces():
    rng = random.Random(0)
    texts = ["a" * 70000, "ab" * 3000, "".join(rng.choice("aeinorst") for _ in range(20000)), "é" * 65, "q" * 64]
    assert encode(texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_the_cache_may_forget(monkeypatch, rows):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    encoder = pieces.PieceEncoder(byte_pairs.SegmentTreeEncoder(RANKS))
    for _, text in rows:
        ids, at = encoder(*arrays.text_buffer(pa.array([text], pa.string())))
        assert ids.tolist() == PUBLIC.encode_ordinary(text or "")


def test_encode_and_decode(docs, rows):
    back = byte_pairs.decode(byte_pairs.encode(docs, "text"), "ids")
    assert set(docs.columns) < set(back.columns)
    got = sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in back.collect())
    assert got == sorted((i, PUBLIC.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)


def test_round_trip(docs, empty, rows):
    got = sorted(tuple(r) for r in byte_pairs.round_trip(docs, "doc_id", "text").collect())
    expected = []
    for i, text in rows:
        ids = np.array(PUBLIC.encode_ordinary(text or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected)
    assert byte_pairs.round_trip(empty, "doc_id", "text").collect() == []


# --- packing ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_is_best_fit(lengths):
    bins, offsets, fills = packing.best_fit(lengths, 40)
    plain, where = [], {}
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        rooms = [(40 - f, b) for b, f in enumerate(plain) if 40 - f >= lengths[item]]
        if rooms:
            chosen = min(rooms)[1]
        else:
            chosen = len(plain)
            plain.append(0)
        where[item] = plain[chosen]
        plain[chosen] += lengths[item]
    assert sorted(fills) == sorted(plain)
    assert sum(fills) == sum(lengths) and all(f <= 40 for f in fills)
    assert all(offsets[i] + lengths[i] <= fills[bins[i]] for i in range(len(lengths)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_of_counts(lengths):
    groups = packing.best_fit_counts(dict(collections.Counter(lengths)), 40)
    fills = [sum(length for length, _ in places) for many, places in groups for _ in range(many)]
    assert sorted(fills) == sorted(packing.best_fit(lengths, 40)[2])
    items = [(length, at + i) for many, places in groups for length, at in places for i in range(many)]
    wanted = [(length, i) for length, many in collections.Counter(lengths).items() for i in range(many)]
    assert sorted(items) == sorted(wanted)


def test_counts_stay_few():
    counts = {length: 10**9 + length for length in range(1, 1009)}
    groups = packing.best_fit_counts(counts, 1024)
    assert sum(len(places) for _, places in groups) < 20_000
    held = collections.Counter()
    for many, places in groups:
        assert sum(length for length, _ in places) <= 1024
        held.update({length: many * n for length, n in collections.Counter(length for length, _ in places).items()})
    assert held == counts


def check_packing(found, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    copies = collections.Counter(i for i, _ in texts)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, tokens in ids.items():
        cuts = sorted(by_doc[i])[:: copies[i]]
        assert [c[0] for c in cuts] == list(range(len(cuts))) and sum(c[2] for c in cuts) == len(tokens)
        assert len(tokens) > capacity or len(cuts) == 1
        assert all(c[2] == capacity for c in cuts[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(len(ids[i]) for i, _ in texts)


def test_packing(docs, empty, rows, monkeypatch):
    for nodes, partitions, more in ((packing.NODE, 3, 1), (5, 9, 6)):
        monkeypatch.setattr(packing, "NODE", nodes)
        monkeypatch.setattr(packing, "FAN", 2)
        found = packing.pack(docs.repartition(partitions), "doc_id", "text", 1024).collect()
        sequences, tokens = check_packing(found, rows, 1024)
        assert sequences <= -(-tokens // 1024) + more
    assert packing.pack(empty, "doc_id", "text").collect() == []


def test_packing_of_what_does_not_fit_together(spark):
    rows = [(i, " the" * 700) for i in range(40)] + [(100 + i, " the" * 300) for i in range(40)]
    found = packing.pack(table(spark, rows).repartition(8), "doc_id", "text").collect()
    assert check_packing(found, rows, 1024)[0] <= 42


def test_packing_through_many_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE", 7)
    monkeypatch.setattr(packing, "FAN", 3)
    rng = np.random.default_rng(6)
    rows = [(i, " the" * int(n)) for i, n in enumerate(rng.choice([3, 60, 200, 341, 500, 700, 1100, 2500], 400))]
    found = packing.pack(table(spark, rows).repartition(30), "doc_id", "text").collect()
    sequences, tokens = check_packing(found, rows, 1024)
    lengths = [r["length"] for r in found]
    assert sequences <= len(packing.best_fit(lengths, 1024)[2]) * 1.05


# --- language model -----------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(3)
    weights = [w.astype(np.float64) for w in language.new_weights(np.full(language.CLASSES, 1 / language.CLASSES))]
    x, y = rng.integers(0, language.CLASSES, (2, 5, 3))
    mask = np.ones((5, 3), bool)
    mask[3:, 0] = mask[4:, 1] = False
    state = rng.standard_normal((3, language.STATE)) * 0.1
    _, grads, _ = language.window_loss(weights, x, y, mask, state)
    for w, g in zip(weights, grads):
        for at in rng.integers(0, w.size, 12):
            old, step, likely = w.flat[at], 1e-5, []
            for change in (step, -step):
                w.flat[at] = old + change
                likely.append(language.window_loss(weights, x, y, mask, state)[0])
            w.flat[at] = old
            assert -(likely[0] - likely[1]) / (2 * step) / mask.sum() == pytest.approx(g.flat[at], abs=1e-6)


def test_large_weights_do_not_overflow():
    rng = np.random.default_rng(8)
    weights = language.new_weights(np.full(language.CLASSES, 1 / language.CLASSES))
    weights[3][:] = rng.permutation(language.CLASSES) * 4
    x, y = rng.integers(0, language.CLASSES, (2, 30, 3))
    likely, grads, _ = language.window_loss(weights, x, y, np.ones(x.shape, bool), np.zeros((3, language.STATE), np.float32))
    assert np.isfinite(likely) and all(np.isfinite(g).all() for g in grads)
    assert np.isfinite(language.score(weights, [y[:, 0].astype(np.uint8)])).all()


@pytest.mark.parametrize("lanes", [1, 64])
def test_exponentials_are_gone_over_once(lanes):
    """The wide rows (128 classes a token) are neither scaled nor searched for maxima: it took a quarter of training."""
    weights = language.new_weights(np.full(language.CLASSES, 1 / language.CLASSES))
    x, y = np.random.default_rng(9).integers(0, language.CLASSES, (2, language.WINDOW, lanes))
    hidden = language._roll(weights, x, np.zeros((lanes, language.STATE), np.float32))[0][1:].reshape(-1, language.STATE)
    likely, error, total = language._likely(language._with_one(hidden), weights, y.ravel())
    logits = hidden.astype(np.float64) @ weights[2] + weights[3]
    assert np.allclose(error, np.exp(logits), rtol=1e-5) and np.allclose(total, np.exp(logits).sum(axis=1), rtol=1e-5)
    assert np.allclose(likely, (logits - np.log(np.exp(logits).sum(axis=1))[:, None])[np.arange(len(logits)), y.ravel()], atol=1e-5)


def test_state_is_carried_through_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    weights = language.new_weights(np.full(language.CLASSES, 1 / language.CLASSES))
    texts = [rng.integers(0, language.CLASSES, n).astype(np.uint8) for n in (1, 24, 25, 300, 77)]
    found = language.score(weights, texts)
    for text, total in zip(texts, found):
        state, given, likely = np.zeros((1, language.STATE), np.float32), 0, 0.0
        for token in text:
            state = language._step(weights, np.array([given]), state)[0]
            logits = (state @ weights[2] + weights[3])[0].astype(float)
            likely += logits[token] - np.log(np.exp(logits).sum())
            given = int(token)
        assert total == pytest.approx(likely / np.log(10), rel=1e-4)


def unigram(rows):
    word, lower = re.compile(rb"[^\x20\x09-\x0D]+"), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(i, [*word.findall((t or "").encode().translate(lower)), None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter(w for i, text in tokens if not held[i] for w in text)
    n, floor = counts.total(), counts.total() + len(counts) + 1
    return sorted(
        (i, held[i], len(text), sum(w in counts for w in text), n, sum(math.log10((counts[w] + 1) / floor) for w in text))
        for i, text in tokens
    )


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


@pytest.mark.parametrize("number", [0, 1])
def test_every_window_is_trained_on_in_order_with_the_state_carried(monkeypatch, number):
    rng = np.random.default_rng(6)
    texts = [np.full(n, i, np.uint8) for i, n in enumerate((1, 24, 25, 70, 96, 300))]
    taken, ends, plain = {i: 0 for i in range(len(texts))}, {}, language.window_loss

    def recorded(weights, x, y, mask, h):
        result = plain(weights, x, y, mask, h)
        for lane in range(mask.shape[1]):
            text = int(y[0, lane])
            assert np.array_equal(h[lane], ends.get(text, np.zeros(language.STATE)))
            taken[text] += int(mask[:, lane].sum())
            ends[text] = result[2][lane]
        return result

    monkeypatch.setattr(language, "window_loss", recorded)
    weights = language.new_weights(np.full(language.CLASSES, 1 / language.CLASSES))
    seen = language.train(weights, [texts[i] for i in rng.permutation(len(texts))], number)
    assert taken == {i: len(text) for i, text in enumerate(texts)}
    assert seen == sum(len(text) for text in texts)


def test_base_score(docs, empty, rows):
    found = sorted(tuple(r) for r in language.log_likelihoods(docs, "doc_id", "text", held_out()).collect())
    for got, expected in zip(found, unigram(rows), strict=True):
        assert got[:5] == expected[:5] and got[5] == pytest.approx(expected[5], rel=1e-9)
        assert got[6] < 0
    assert language.log_likelihoods(empty, "doc_id", "text", held_out()).collect() == []


def test_the_model_is_better_than_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in language.log_likelihoods(docs, "doc_id", "text", held_out()).collect() if r["held_out"]]
    assert len(rows) > 10 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_of_the_vocabulary_sum_to_one(spark):
    """One-word texts of every known word and one unknown word, all from one state."""
    words = [f"w{i}" for i in range(60)]
    train = [(i, " ".join(words[: 60 - i % 50])) for i in range(60)]
    held = F.col("doc_id") >= 1000
    probes = [(1000 + i, w) for i, w in enumerate([*words, ""])]
    scored = language.log_likelihoods(table(spark, train + probes), "doc_id", "text", held)
    # A text is its word and then the end; divide the end away by bounding it with 1.
    total = sum(10 ** r["score"] for r in scored.where("held_out").collect())
    assert total <= 1.0
