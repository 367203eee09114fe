"""Scores from tables against plain products, mining against its definition."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shotweave.llm import negatives

NAN, INF = float("nan"), float("inf")


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 3), st.sampled_from([1, 100, 20000, 2**28]), st.integers(1, 20), st.integers(0, 1500), st.integers(0, 99))
def test_scores_are_inner_products(groups, size, k, n, seed):
    rng = np.random.default_rng(seed)
    anchors = rng.integers(-size, size + 1, (k, 8 * groups))
    rows = rng.integers(-size, size + 1, (n, 8 * groups))
    if n:
        rows[0] = -size
    found = negatives.scores(anchors.astype(np.int32), negatives.pack_planes(rows))
    assert np.array_equal(found, anchors @ rows.T)


def test_scores_beyond_the_result_type_are_refused():
    wide = np.full((1, 8), 2**31 - 1)
    with pytest.raises(ValueError, match="64 bits"):
        negatives.scores(wide, negatives.pack_planes(wide))


def mined(rows, every, positives, count):
    """The definition, over (id, label, vector) rows."""
    one = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        one[i] = min(one.get(i, (label, vector)), (label, vector))
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a, (label, va) in ints.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in ints.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if ints[i][0] == label][:positives]:
            fitting = [i for i in best if ints[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fitting[:count])]
    return sorted(out)


def messy_rows(n=260, dims=9):
    rng = random.Random(4)
    centre = [[rng.choice([-0.5, 0.5]) for _ in range(dims)] for _ in range(4)]
    rows = [(i, i % 3, [x + rng.choice([-0.25, 0.0, 0.25]) for x in centre[rng.randrange(4)]]) for i in range(n)]
    odd = [
        (None, 1, [1.0] * dims), (300, None, [1.0] * dims), (305, 1, None), (310, 1, [1.0, None]), (315, 0, [NAN] * dims),
        (320, 1, [INF] + [0.0] * 8), (325, 1, []), (330, 2, [0.5] * 30), (335, 0, [1.0, 1.0]), rows[5], rows[10],
        (10, 0, [9.0] * dims), (-5, 1, [0.5] * dims), (340, 1, [1e6, -1e6] + [0.1] * 7), (345, -3, [0.5] * dims),
        (2**40, 1, [0.5] * dims), (350, 1, [-1.0] * dims),
    ]
    return rows + odd


@pytest.mark.parametrize("cell, block", [(1 << 12, 1 << 13), (20, 7)])
def test_mining(spark, monkeypatch, cell, block):
    monkeypatch.setattr(negatives, "LEAST_CELL", cell)
    monkeypatch.setattr(negatives, "CELL", cell)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = messy_rows()
    wide = [(*row, "x", 1, 2) for row in rows]
    df = spark.createDataFrame(wide, "id bigint, label int, vector array<double>, cell string, block int, rank int").repartition(3)
    found = negatives.hard_negatives(df, "id", "label", "vector", F.col("id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows, 5, 5, 3)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(5, 1, [1.0])], [(5, 1, [1.0]), (6, 1, [1.0])]])
def test_nothing_to_mine(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, label int, vector array<float>")
    assert negatives.hard_negatives(df, "id", "label", "vector", F.col("id") % 5 == 0).collect() == []


def test_one_vector_in_most_rows(spark):
    rows = [(i, i % 2, [0.5, 0.25] if i % 3 else [0.25, 0.25]) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, label int, vector array<double>")
    found = negatives.hard_negatives(df, "id", "label", "vector", F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows, 50, 5, 3)
