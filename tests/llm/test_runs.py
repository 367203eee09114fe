"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotweave.llm import queries, runs
from tests.llm.conftest import table

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode() for w in WORDS.findall((text or "").encode())]


def by_definition(w, least, times):
    """(start, end, period) of maximal stretches, tried period by period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@st.composite
def texts(draw):
    letters = draw(st.integers(1, 4))
    unit = draw(st.lists(st.integers(0, letters), max_size=12))
    return draw(st.lists(st.integers(0, letters), max_size=15)) + unit * draw(st.integers(0, 6)) + unit[: draw(st.integers(0, 12))]


@settings(max_examples=400, deadline=None)
@given(st.lists(texts(), max_size=5), st.sampled_from([(1, 2), (5, 2), (6, 3)]), st.sampled_from([0, 1, 16]), st.sampled_from([2, 1 << 20]))
def test_runs_are_those_of_the_definition(some, limits, jumps, looks):
    flat = np.array([x for t in some for x in t], np.int64)
    firsts = np.cumsum([0, *map(len, some)])
    before = runs.JUMPS, runs.LOOKS
    runs.JUMPS, runs.LOOKS = jumps, looks
    try:
        found = list(zip(*(x.tolist() for x in runs.find_runs(flat, firsts, *limits))))
    finally:
        runs.JUMPS, runs.LOOKS = before
    assert found == [(s + f, e + f, q) for t, f in zip(some, firsts.tolist()) for s, e, q in by_definition(t, *limits)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(runs, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    raw = np.frombuffer(b"a b a ab b", np.uint8)
    starts, ends, _ = runs.word_spans(raw, np.array([0, len(raw)]))
    assert runs.word_numbers(raw, starts, ends).tolist() == [0, 1, 0, 2, 1]


def test_collapse(spark, rows):
    rng = random.Random(2)
    for i in range(20):
        unit = [rng.choice(["ja", "nein", "oui", "é"]) for _ in range(rng.randint(1, 9))]
        rows = [*rows, (1000 + i, " \t\n".join(unit * rng.randint(2, 30) + unit[:2]) + "\n")]
    got = runs.collapse_runs(table(spark, rows).withColumnRenamed("spans", "runs"), "text").collect()
    want = []
    for i, text in rows:
        found = by_definition(words(text), 24, 3)
        want.append((i, [(s, e - s, q) for s, e, q in found], collapsed(words(text), found)))
    assert sorted((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)
    assert any(len(r["runs"]) > 0 for r in got) and got[0]["kept"] == "k"


def test_no_rows(empty):
    assert runs.collapse_runs(empty, "text").collect() == []


def test_long_and_periodic_texts():
    one = np.concatenate([np.zeros(30000, int), [1], np.zeros(20000, int), [2], np.arange(40000) % 7])
    found = list(zip(*(x.tolist() for x in runs.find_runs(one, np.array([0, len(one)]), 24, 3))))
    assert found == [(0, 30000, 1), (30001, 50001, 1), (50002, 90002, 7)]


@pytest.mark.parametrize("name", ["sf0.001", "edges"])
def test_query_against_its_contract(spark, tmp_path, rows, name):
    source = f"/root/testdata/{name}"
    if name == "edges":
        source = str(tmp_path)
        table(spark, rows).write.parquet(f"{source}/documents.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc_id, text in docs:
        w = words(text)
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = by_definition(w, 24, 3)
        best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
        shown = (None,) * 4
        if best:
            s, e, q = best
            shown = (s, e - s, q, 1000 * (e - s) // q)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, found))]
        expected.append((doc_id, len(found), *shown, *digests))
    df = queries.op13_periodic_runs(spark, source)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(expected)
