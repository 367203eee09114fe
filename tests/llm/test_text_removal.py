"""Repeated strings and chunks against brute force."""

import random

import numpy as np
import pytest

from shotweave.llm import chunks, suffix
from tests.llm.conftest import table


def removed_by_brute_force(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for start in range(len(data) - length + 1):
            string = data[start : start + length]
            if string in seen:
                gone[start : start + length] = True
            seen.add(string)
        out[doc_id] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


def result(df):
    found = {}
    for row in df.collect():
        found.setdefault(row["doc_id"], set()).add((bytes(row["kept"]), tuple((s["start"], s["length"]) for s in row["spans"])))
    return found


def check_spans(rows, found):
    for doc_id, text in rows:
        ((kept, spans),) = found[doc_id]
        data, left, at = (text or "").encode(), b"", 0
        for start, length in spans:
            assert start >= at and (start > at or not at) and length > 0
            left += data[at:start]
            at = start + length
        assert left + data[at:] == kept


def test_repeats(spark, docs, rows):
    df = suffix.remove_repeats(docs, "doc_id", "text")
    assert df.columns == [c for c in docs.columns if c not in ("kept", "spans")] + ["kept", "spans"]
    assert df.count() == len(rows)
    found = result(df)
    check_spans(rows, found)
    assert {k: next(iter(v))[0] for k, v in found.items()} == removed_by_brute_force(rows, 100)


@pytest.mark.parametrize("length", [20, 31, 40, 100, 300, 1000])
def test_repeats_in_random_text(spark, length):
    rng = random.Random(length)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 150))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6 + length // 50)))) for i in range(60)]
    found = result(suffix.remove_repeats(table(spark, rows, extra=False), "doc_id", "text", length))
    assert {k: next(iter(v))[0] for k, v in found.items()} == removed_by_brute_force(rows, length)


def test_a_line_in_a_third_of_the_documents(spark):
    """The line is shorter than a string, so what stands beside it decides."""
    rng = random.Random(8)
    line = "all rights reserved, see the terms of use and the notes"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    around = [" ".join(word() for _ in range(12)) for _ in range(25)]
    rows = [(i, f"{rng.choice(around)} {line} {rng.choice(around)}" if i % 3 == 0 else rng.choice(around)) for i in range(300)]
    found = result(suffix.remove_repeats(table(spark, rows, extra=False), "doc_id", "text"))
    assert {k: next(iter(v))[0] for k, v in found.items()} == removed_by_brute_force(rows, 100)


def test_null_ids_and_rows_of_one_id(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(None, long), (5, long), (5, "z" + long), (7, "q" * 120)]
    found = result(suffix.remove_repeats(table(spark, rows), "doc_id", "text"))
    assert found[None] == {(long.encode(), ())}
    assert found[5] == {(b"", ((0, 300),)), (b"z", ((1, 300),))}


@pytest.mark.parametrize("length", [1, 3, 4, 5, 31, 100])
def test_bucket_refinement(length):
    rng = random.Random(length)
    for _ in range(60):
        contexts = [bytes(rng.choice(b"ab") for _ in range(length + rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        contexts += rng.choices(contexts, k=3)
        data = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.array([len(c) for c in contexts])
        starts, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        seen, want = set(), []
        for c in contexts:
            for i in range(len(c) - length + 1):
                want.append(c[i : i + length] in seen)
                seen.add(c[i : i + length])
        assert suffix.repeats(data, starts, counts, length).tolist() == want


def test_rounds_leave_out_what_is_alone(monkeypatch):
    """The last round sorts suffixes only, and every round only members that are not alone."""
    rng, sizes, sort = np.random.default_rng(3), [], suffix._sorted
    monkeypatch.setattr(suffix, "_sorted", lambda key, at, n: sizes.append(len(at)) or sort(key, at, n))
    data = rng.integers(0, 256, 40_000, np.uint8)
    data[30_000:30_150] = data[:150]
    flags = suffix.repeats(data, np.array([0, 20_000]), np.array([19_901, 19_901]), 100)
    assert np.flatnonzero(flags).tolist() == list(range(29_901, 29_952))
    assert sizes[0] == 40_000 and max(sizes[1:]) < 400 and sizes[-1] == 2 * 87


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 101, 6 << 20).astype(np.uint8)
    whole = np.array([0, len(raw)])
    found = list(suffix._within(raw, whole, 100))
    assert len(found) > 1
    covered = np.concatenate([np.arange(a, a + n) for _, first, count, _ in found for a, n in zip(first, count)])
    assert (np.sort(covered) == np.arange(len(raw) - 99)).all()
    _, first, count, key = suffix.contexts(raw[: 1 << 20], np.array([0, 1 << 20]), 100)
    inner = found[0]
    assert (key == inner[3][: len(key)]).all() and (first == inner[1][: len(key)]).all()


def chunks_by_brute_force(rows):
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        hash_, begin, cuts = 0, 0, []
        for i, byte in enumerate(data):
            hash_ = (2 * hash_ + int(chunks._GEAR[byte])) % 2**32
            size = i + 1 - begin
            if (size >= chunks.SHORTEST and not hash_ & int(chunks._MASK)) or size == chunks.LONGEST:
                cuts.append((begin, i + 1))
                begin = i + 1
        if begin < len(data):
            cuts.append((begin, len(data)))
        if len(cuts) > 1 and cuts[-1][1] - cuts[-1][0] < chunks.SHORTEST:
            cuts[-1] = (cuts[-2][0], len(data))  # the end together with the chunk before it
        gone = np.zeros(len(data), bool)
        for a, b in cuts:
            if data[a:b] in seen:
                gone[a:b] = True
            seen[data[a:b]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        for a, b in edges.reshape(-1, 2):
            if b - a < min(chunks.LEAST_RUN, len(data)):
                gone[a:b] = False
        out[doc_id] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


def test_chunks(spark, docs, rows):
    df = chunks.remove_chunks(docs, "doc_id", "text")
    assert df.count() == len(rows)
    found = result(df)
    check_spans(rows, found)
    assert {k: next(iter(v))[0] for k, v in found.items()} == chunks_by_brute_force(rows)


def test_chunks_of_short_copies_and_tails(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lengths = [1, 5, 15, 16, 17, 31, 40, 79, 80, 81, 100, 131, 150, 260, 777]
    texts = [text(n) for n in lengths]
    rows = [(i, t) for i, t in enumerate(texts + texts[::-1])]
    found = result(chunks.remove_chunks(table(spark, rows), "doc_id", "text"))
    assert {k: next(iter(v))[0] for k, v in found.items()} == chunks_by_brute_force(rows)
    assert all(next(iter(found[i]))[0] == b"" for i in range(len(texts), len(rows)))
    assert all(next(iter(found[i]))[0] == t.encode() for i, t in enumerate(texts))


def test_chunks_resist_shifts(spark):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = [(i, f"{'w' * i} {i} {passage} end {i}") for i in range(20)]
    found = result(chunks.remove_chunks(table(spark, rows), "doc_id", "text"))
    left = [len(next(iter(found[i]))[0]) for i in range(1, 20)]
    assert max(left) < len(passage) * 0.6


def test_no_rows(empty):
    assert suffix.remove_repeats(empty, "doc_id", "text").collect() == []
    assert chunks.remove_chunks(empty, "doc_id", "text").collect() == []


def test_columns_of_blobs_are_joined_and_given_up():
    """What has been joined is not held a second time."""
    parts = [[np.arange(3), np.full(2, 7)], [np.arange(2), np.full(1, 8)]]
    again = list(parts)
    first, second = suffix._joined_columns(parts)
    assert first.tolist() == [0, 1, 2, 0, 1] and second.tolist() == [7, 7, 8]
    assert parts == [] and again == [[None, None], [None, None]]
