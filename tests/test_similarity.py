import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from shotweave.operators import blocks, joins, similarity
from shotweave.functions.fingerprints import fingerprint, pack_bits, packed_fingerprint, packed_size, tanimoto
from shotweave.operators.shots import apply_shortfall, random_shots, select_shots, shots_array
from shotweave.operators.similarity import build_index, knn, neighbour_rows, with_fingerprint

WORDS = [f"w{i}" for i in range(40)]


def brute_force(queries, index, k, exclude_self):
    result = {}
    for q, a in queries.items():
        scored = []
        for c, b in index.items():
            if exclude_self and c == q:
                continue
            shared = len(a & b)
            scored.append((-shared / (len(a) + len(b) - shared), c))
        result[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return result


def texts(spark, n, seed, offset=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < 0.33:
            rows.append((offset + i, "one hot text"))
        else:
            rows.append((offset + i, " ".join(rng.sample(WORDS, rng.randint(1, 30)))))
    return spark.createDataFrame(rows, "row_id long, text string")


def bit_sets(df):
    rows = with_fingerprint(df, "text").select("row_id", "fp").collect()
    return {r["row_id"]: set(r["fp"]) for r in rows}


def answers(df):
    return {r["row_id"]: [tuple(n) for n in r["neighbours"]] for r in df.collect()}


@pytest.mark.parametrize("k", [1, 4, 60])
@pytest.mark.parametrize("block_rows", [16, 8192])
def test_search_equals_brute_force(spark, monkeypatch, k, block_rows):
    monkeypatch.setattr("shotweave.operators.similarity.MIN_BLOCK_ROWS", 8)
    q, c = texts(spark, 60, 1, 1000), texts(spark, 150, 2)
    found = knn(build_index(q, "text"), build_index(c, "text"), k, block_rows=block_rows)
    assert answers(found) == brute_force(bit_sets(q), bit_sets(c), k, False)


@pytest.mark.parametrize("copies", [1, 7])
def test_leave_one_out_keeps_copies(spark, monkeypatch, copies):
    monkeypatch.setattr("shotweave.operators.similarity.MIN_BLOCK_ROWS", 8)
    monkeypatch.setattr("shotweave.operators.similarity.QUERIES_PER_COPY", 60 // copies)
    rows = texts(spark, 120, 3)
    index = build_index(rows, "text")
    found = answers(knn(index, index, 5, exclude_self=True, block_rows=20))
    assert found == brute_force(bit_sets(rows), bit_sets(rows), 5, True)


def test_large_indexes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("shotweave.storage.BROADCAST_BELOW", 0)
    rows = texts(spark, 90, 4)
    index = build_index(rows, "text")
    found = knn(index, index, 3, exclude_self=True)
    assert answers(found) == brute_force(bit_sets(rows), bit_sets(rows), 3, True)
    listed = shots_array(neighbour_rows(found), index, "text", F.col("neighbour_id").cast("string"))
    texts_of = {r["row_id"]: r["text"] for r in rows.collect()}
    shown = {r["query_id"]: [(s["text"], int(s["label"])) for s in r["shots"]] for r in listed.collect()}
    assert shown == {q: [(texts_of[c], c) for c, _ in n] for q, n in answers(found).items()}


def test_zero_similarity_fills_up_in_row_order(spark):
    c = spark.createDataFrame([(i, f"other{i}") for i in range(5)] + [(9, "mine")], "row_id long, text string")
    q = spark.createDataFrame([(100, "mine")], "row_id long, text string")
    found = answers(knn(build_index(q, "text"), build_index(c, "text"), 3))
    assert found == {100: [(9, 1.0), (0, 0.0), (1, 0.0)]}


def test_rows_without_fingerprint_are_left_out(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "a")], "row_id long, text string")
    assert [r["row_id"] for r in build_index(df, "text").collect()] == [3]
    assert build_index(df, "text", keep_all=True).count() == 3


def test_tanimoto_and_packing(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([0, 2047], [5])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(tanimoto(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]
    packed = df.select(pack_bits(F.col("a")).alias("a"), pack_bits(F.col("b")).alias("b"))
    sizes = packed.select(packed_size(F.col("a")), packed_size(F.col("b"))).collect()
    assert [tuple(r) for r in sizes] == [(2, 2), (2, 1)]


def test_character_runs(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",)], "t string")
    sizes = [r[0] for r in df.select(F.size(fingerprint(F.col("t"), size=3, unit="char"))).collect()]
    assert sizes == [2, 1, None]


def pool(spark, labels):
    rows = [(1, i + 1, i, 1.0 - i / 10, label) for i, label in enumerate(labels)]
    return spark.createDataFrame(
        rows, "query_id long, rank int, neighbour_id long, similarity double, label string"
    )


def test_diversity_takes_half_of_each(spark):
    chosen = select_shots(pool(spark, ["Yes"] * 6 + ["No"] * 6 + ["odd"]), "diversity", 5).collect()
    assert sorted(r["rank"] for r in chosen) == [1, 2, 3, 4, 5]
    assert sum(r["neighbour_id"] < 6 for r in chosen) == 3
    assert sum(6 <= r["neighbour_id"] < 12 for r in chosen) == 2


def test_one_sided_pool_falls_short(spark):
    assert select_shots(pool(spark, ["Yes"] * 4), "diversity", 2).count() == 1
    assert select_shots(pool(spark, ["Yes"]), "random", 2).count() == 0
    assert select_shots(pool(spark, ["Yes"] * 3), "similarity", 2).count() == 2


@pytest.mark.parametrize("n, k, expected", [(10, 3, 3), (3, 3, 3), (2, 3, 0)])
def test_random_shots_are_distinct(spark, n, k, expected):
    index = spark.range(n).select((F.col("id") * 5).alias("row_id"))
    rows = random_shots(spark.range(50).withColumnRenamed("id", "row_id"), index, k).collect()
    per_query = {}
    for r in rows:
        per_query.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"]))
    if not expected:
        assert not per_query
        return
    assert len(per_query) == 50
    for found in per_query.values():
        assert sorted(rank for rank, _ in found) == list(range(1, k + 1))
        assert len({i for _, i in found}) == k


def test_shortfall_policies(spark):
    df = spark.createDataFrame(
        [(1, [("a", "Yes")]), (2, [("a", "Yes"), ("b", "No")]), (3, None)],
        "row_id long, shots array<struct<text:string,label:string>>",
    )
    shown = {
        policy: {r["row_id"]: len(r["shots"]) for r in apply_shortfall(df, 2, policy).collect()}
        for policy in ("use_what_is_there", "drop_query", "keep_instruction", "zero_shot")
    }
    assert shown == {
        "use_what_is_there": {1: 1, 2: 2, 3: 0}, "drop_query": {2: 2},
        "keep_instruction": {1: 0, 2: 2, 3: 0}, "zero_shot": {1: 0, 2: 2, 3: 0},
    }
    with pytest.raises(ValueError, match="unknown policy"):
        apply_shortfall(df, 2, "other")


def task_texts(spark, first_id):
    """Three tasks, one with most rows, a hot text in all of them, and rows without a task."""
    rng = random.Random(first_id)
    rows = []
    for i in range(260):
        task = rng.choice(["big"] * 8 + ["small", None]) if i < 250 else "only here" if first_id else "only there"
        text = "one hot text" if rng.random() < 0.33 else " ".join(rng.sample(WORDS, rng.randint(1, 30)))
        rows.append((first_id + i, task, None if i % 50 == 7 else text))
    return spark.createDataFrame(rows, "row_id long, task string, text string")


@pytest.mark.parametrize("broadcast_below", [0, 2**24])
@pytest.mark.parametrize("k, block_rows, per_copy", [(3, 16, 10), (3, 8192, 10**6), (50, 16, 10**6)])
def test_tasks_are_searched_apart(spark, monkeypatch, k, block_rows, per_copy, broadcast_below):
    monkeypatch.setattr("shotweave.operators.similarity.MIN_BLOCK_ROWS", 8)
    monkeypatch.setattr("shotweave.operators.similarity.QUERIES_PER_COPY", per_copy)
    monkeypatch.setattr("shotweave.storage.BROADCAST_BELOW", broadcast_below)
    q, c = task_texts(spark, 1000), task_texts(spark, 0)
    found = answers(knn(build_index(q, "text"), build_index(c, "text"), k, block_rows=block_rows, task="task"))
    expected, q_bits, c_bits = {}, *[{r["row_id"]: (r["task"], set(r["fp"])) for r in
        with_fingerprint(side, "text").where("fp IS NOT NULL").collect()} for side in (q, c)]
    for task in ("big", "small", None):
        of_task = [{i: fp for i, (t, fp) in side.items() if t == task} for side in (q_bits, c_bits)]
        expected |= brute_force(*of_task, k, False)
    assert found == expected and len(found) > 200


def test_task_without_itself(spark, monkeypatch):
    monkeypatch.setattr("shotweave.operators.similarity.MIN_BLOCK_ROWS", 8)
    rows = task_texts(spark, 0)
    index = build_index(rows, "text")
    found = answers(knn(index, index, 4, exclude_self=True, block_rows=20, task="task"))
    for task in ("big", "small", "only there", None):
        alone = build_index(rows.where(F.col("task").eqNullSafe(F.lit(task))), "text")
        own = answers(knn(alone, alone, 4, exclude_self=True, block_rows=20))
        assert own and {q: found[q] for q in own} == own
    assert len(found) == index.count()


def test_no_tasks_at_all(spark):
    none = build_index(spark.createDataFrame([], "row_id long, task string, text string"), "text")
    some = build_index(task_texts(spark, 0), "text")
    assert knn(none, some, 3, task="task").count() == 0 and knn(some, none, 3, task="task").count() == 0


@pytest.mark.parametrize("rows,most", [(1, 2048), (2, 255), (7, 256), (2050, 2048), (3001, 200)])
def test_counts_in_one_float_are_exact(rows, most):
    rng = np.random.default_rng(rows)
    sizes = np.concatenate([[most], rng.integers(1, most + 1, rows + 20)])
    dense = np.zeros((len(sizes), 2048), dtype=np.uint8)
    for row, size in zip(dense, sizes):
        row[rng.permutation(2048)[:size]] = 1
    dense[-1] = dense[0]
    fps = np.packbits(dense, axis=1)
    block = similarity._Block(fps[:rows], sizes[:rows].astype(np.int64), np.arange(rows))
    found = block.shared(fps[rows:], int(dense[rows:].sum(1).max()))
    assert (found == dense[rows:].astype(np.int64) @ dense[:rows].astype(np.int64).T).all()


def test_tasks_of_a_search_grow_with_its_comparisons(spark, monkeypatch):
    """Beside the shuffle partitions, or the longest task grows with the square of the input."""
    shown, visit = [], similarity._visit

    def seen(*args):
        found = visit(*args)
        shown.append(found.rdd.getNumPartitions())
        return found

    monkeypatch.setattr(similarity, "MIN_BLOCK_ROWS", 8)
    monkeypatch.setattr(similarity, "QUERIES_PER_COPY", 4)
    monkeypatch.setattr(similarity, "CELLS_PER_TASK", 16)
    monkeypatch.setattr(similarity, "_visit", seen)
    q, c = texts(spark, 90, 1, 1000), texts(spark, 160, 2)
    found = knn(build_index(q, "text"), build_index(c, "text"), 3, block_rows=16)
    assert answers(found) == brute_force(bit_sets(q), bit_sets(c), 3, False)
    assert shown[-1] > 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("task", [None, "task"])
def test_places_are_dealt_out_evenly(spark, monkeypatch, task):
    """By hash, several blocks met in one task while others had none."""
    dealt, visit = [], similarity._visit

    def seen(queries, index, *args):
        monkeypatch.setattr(similarity, "_best_in_block", lambda k: places)
        rows = visit(queries, index, *args).groupBy("query").agg(F.countDistinct("candidate").alias("n")).collect()
        dealt.append([r["n"] for r in rows])
        monkeypatch.setattr(similarity, "_best_in_block", best)
        return visit(queries, index, *args)

    def places(batches):
        for batch in batches:
            part = pa.array(np.full(batch.num_rows, TaskContext.get().partitionId()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part, batch.column("place"), batch.column("floor")], names=["query", "candidate", "similarity"]
            )

    best = similarity._best_in_block
    monkeypatch.setattr(similarity, "MIN_BLOCK_ROWS", 8)
    monkeypatch.setattr(similarity, "QUERIES_PER_COPY", 30)
    monkeypatch.setattr(similarity, "_visit", seen)
    make = texts if task is None else task_texts
    index = build_index(make(spark, 160, 2) if task is None else make(spark, 160), "text")
    found = answers(knn(index, index, 3, block_rows=16, task=task))
    assert len(found) and all(max(n) - min(n) <= 1 for n in dealt)


def random_sets(rng, sizes, crowded=0):
    """Bit sets; rows after the first ``crowded`` ones share half of an earlier row's bits."""
    dense = np.zeros((len(sizes), 2048), dtype=np.uint8)
    for i, size in enumerate(sizes):
        taken = np.flatnonzero(dense[rng.integers(crowded)])[: size // 2] if i >= crowded > 0 else []
        dense[i, taken] = 1
        dense[i, rng.permutation(2048)[: size - len(taken)]] = 1
    return np.packbits(dense, axis=1), dense.sum(1).astype(np.int64)


@pytest.mark.parametrize("low,high,floats", [(5, 60, 8), (20, 130, 64), (100, 480, 8), (300, 800, 32), (900, 2048, 8)])
@pytest.mark.parametrize("known", [False, True])
def test_comparing_with_a_block_equals_brute_force(monkeypatch, low, high, floats, known):
    rng = np.random.default_rng(low)
    fps, bits = random_sets(rng, rng.integers(low, high + 1, 560), 40)
    held = np.argsort(bits[:400], kind="stable")
    block = blocks.Block(fps[held], bits[held], held)
    dense = np.unpackbits(fps, axis=1).astype(np.int64)
    common = dense[400:] @ dense[:400].T
    value = common / (bits[400:, None] + bits[None, :400] - common)
    order = np.array([np.lexsort((np.arange(400), -row))[:3] for row in value])
    third = value[np.arange(160), order[:, 2]]
    floor = third if known else np.zeros(160)
    seen, whole, products = set(), blocks._whole, blocks.Block.products

    def watched(self, dense, per, width, start, fold=1, parts=1):
        seen.add((per, fold, parts))
        return products(self, dense, per, width, start, fold, parts)

    def not_known(queries, *rest):
        assert not known
        return whole(queries, *rest)

    monkeypatch.setattr(blocks.Block, "products", watched)
    monkeypatch.setattr(blocks, "_whole", not_known)
    for name, size in {"QUERIES": 50, "FLOATS": floats, "SAMPLE": 60, "TRIED": 10, "COUNTED": 7}.items():
        monkeypatch.setattr(blocks, name, size)
    queries = blocks.Queries(fps[400:], bits[400:], np.arange(160), floor)
    found = {}
    for batch in blocks.best(queries, block, 3):
        for q, c, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found.setdefault(q, []).append((c, s))
    assert found == {q: [(c, value[q, c]) for c in order[q]] for q in range(160)}
    # Few bits: columns go together.  Many: they are taken in parts, three rows to a float.
    if known:
        assert max(fold for _, fold, _ in seen) > 1 if high < 256 else max(parts for *_, parts in seen) > 1 or low == 900


def test_a_block_of_equal_rows_is_compared_as_a_whole(monkeypatch):
    """Where nearly all rows reach the floor, what is held stays bounded."""
    fps, bits = random_sets(np.random.default_rng(1), [50] * 2)
    block = blocks.Block(np.repeat(fps[:1], 300, axis=0), np.repeat(bits[:1], 300), np.arange(300))
    monkeypatch.setattr(blocks, "CELLS", 1000)
    queries = blocks.Queries(fps[:1], bits[:1], np.array([7]), np.array([0.5]))
    (batch,) = blocks.best(queries, block, 4)
    assert batch.column("candidate").to_pylist() == [0, 1, 2, 3] and batch.column("similarity").to_pylist() == [1.0] * 4


@pytest.mark.parametrize("options", [{}, {"bits": 512}, {"size": 2}, {"size": 3, "unit": "char"}])
def test_packed_at_once(spark, options):
    """The words of a batch are hashed once each, with the same bits."""
    rows = [("a B a",), ("",), (None,), (" \t",), ("\u00c4 \u00df\u0085x a",), ("x y  z\t\n q\u3000r",), ("\u65e5\u672c \u8a9e",)]
    df = spark.createDataFrame(rows, "text string")
    both = df.select(
        pack_bits(fingerprint(F.col("text"), **options)).alias("a"), packed_fingerprint(F.col("text"), **options).alias("b")
    ).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and sum(r["b"] is None for r in both) == 3


def test_examples_are_collected_once(spark):
    """Before the shuffle nothing of a query meets, so texts are shuffled first and not sorted there."""
    chosen = spark.createDataFrame([(1, 1, 7), (1, 2, 5), (2, 1, 7)], "query_id long, rank int, neighbour_id long")
    index = spark.createDataFrame([(5, "a", "Yes"), (7, "b", "No")], "row_id long, text string, label string")
    listed = shots_array(chosen, index, "text", "label")
    plan = listed._jdf.queryExecution().executedPlan().toString().splitlines()
    collected = [i for i, line in enumerate(plan) if "collect_list" in line]
    shuffled = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(query_id" in line]
    assert collected and len(shuffled) == 1 and max(collected) < shuffled[0]
    shown = {r["query_id"]: [tuple(s) for s in r["shots"]] for r in listed.collect()}
    assert shown == {1: [("b", "No"), ("a", "Yes")], 2: [("b", "No")]}


def test_only_hot_rows_are_written_again(spark, monkeypatch):
    written, write = [], joins.materialise

    def seen(df, label):
        written.append((label, df.columns))
        return write(df, label)

    monkeypatch.setattr("shotweave.storage.BROADCAST_BELOW", 0)
    monkeypatch.setattr(joins, "materialise", seen)
    monkeypatch.setattr(joins, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(i, 7 if i < 20 else i) for i in range(40)], "query_id long, neighbour_id long")
    keyed = spark.range(100).select(F.col("id").alias("neighbour_id"), F.concat(F.lit("t"), "id").alias("text"))
    found = joins.attach_counted(rows, keyed, "neighbour_id")
    texts_of = {r["query_id"]: r["text"] for r in found.collect()}
    assert texts_of == {i: "t7" if i < 20 else f"t{i}" for i in range(40)} and found.count() == 40
    with_text = [label for label, columns in written if "text" in columns]
    assert with_text == ["hot"]
