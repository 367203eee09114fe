"""Deduplication, sharding, fingerprints, quality and the pipeline against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from shotweave.llm import arrays, exact, near, order_minhash, quality, shards
from shotweave.llm.components import components
from shotweave.llm.filters import without
from tests.llm.conftest import table
from tests.llm.test_text_removal import removed_by_brute_force
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def copies_by_brute_force(rows, best):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return sorted(
        (i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    )


@pytest.mark.parametrize("collide", [False, True])
def test_exact(docs, rows, collide):
    digest = (lambda c: (F.length(c) % 3).cast("string")) if collide else F.md5
    for keep, best in (("min", min), ("max", max)):
        found = exact.exact_groups(docs, "doc_id", "text", keep, digest)
        assert sorted(tuple(r) for r in found.collect()) == copies_by_brute_force(rows, best)


def test_exact_rows_that_stay(spark, docs, empty, rows):
    assert exact.exact_groups(empty, "doc_id", "text").collect() == []
    left = exact.drop_exact_copies(docs, "doc_id", "text")
    assert left.columns == docs.columns
    stay = {i for i, _, _, kept, _ in copies_by_brute_force(rows, min) if kept}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in rows if i in stay)
    nulls = table(spark, [(None, "a"), (1, "a"), (2, "b"), (None, "c")])
    assert sorted(map(str, (r["doc_id"] for r in exact.drop_exact_copies(nulls, "doc_id", "text").collect()))) == ["1", "2"]


def test_without_counts_null_as_an_id(spark, docs):
    gone = spark.createDataFrame([(None,), (3,), (3,)], "doc_id bigint")
    rows = table(spark, [(None, "a"), (3, "b"), (4, None)])
    assert [r["doc_id"] for r in without(rows, "doc_id", gone).collect()] == [4]


def test_sql_checks_on_the_smallest_tables(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = contract.queries()["op4_exact_dedup"](spark, SF)
    expected = connection.execute(contract.oracle_sql()["op4_exact_dedup"]).fetchall()
    assert sorted(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == sorted(expected)


def check_shards(found, rows):
    sizes = {i: len((t or "").encode()) + 1 for i, t in rows}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in rows)
    assert all(r["size"] == sizes[r["doc_id"]] and r["text_crc32"] == crc[r["doc_id"]] and r["law"] == "bytes" for r in found)
    by_shard = collections.defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r)
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return [sum(r["size"] for r in by_shard[s]) for s in range(8)]


def test_shards(spark, docs, empty, rows):
    check_shards(shards.balanced_shards(docs, "doc_id", "text").collect(), rows)
    assert shards.balanced_shards(empty, "doc_id", "text").collect() == []
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = contract.queries()["op7_byte_shards"](spark, SF).collect()
    sizes = check_shards(found, real)
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) for _, t in real)
    of_text, texts = collections.defaultdict(set), dict(real)
    for r in found:
        of_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"text {i}") for i in range(100)]
    sizes = check_shards(shards.balanced_shards(table(spark, rows), "doc_id", "text").collect(), rows)
    assert max(sizes) - min(sizes) <= 40


@pytest.mark.parametrize("copies", [(80, 80), (60,) * 5, (250, 90, 70, 55)])
def test_groups_of_half_a_shard_or_more_leave_shards_equal(spark, copies):
    """A shard is 100 times 200 bytes."""
    texts = [f"{k} ".ljust(199, "x") for k, n in enumerate(copies) for _ in range(n)]
    texts += [f"single {i} ".ljust(199, "y") for i in range(800 - len(texts))]
    rows = list(enumerate(texts))
    found = shards.balanced_shards(table(spark, rows), "doc_id", "text").collect()
    sizes = check_shards(found, rows)
    assert max(sizes) - min(sizes) <= 2 * 200
    for k, n in enumerate(copies):
        held = {r["shard"] for r in found if texts[r["doc_id"]] == texts[sum(copies[:k])]}
        assert n > 100 or len(held) == 1


def test_parts_of_shards_fill_them_to_one_level():
    assert shards._bounds([0, 0], 10) == [5, 10]
    assert shards._bounds([8, 0, 2], 5) == [0, 3, 5]
    assert shards._bounds([3, 3, 3], 0) == [0, 0, 0]


# --- order MinHash --------------------------------------------------------------


def plain_fingerprint(text):
    """The same definition, one k-mer and one function at a time."""
    hashes = order_minhash.kmers(text)
    if not len(hashes):
        return [0] * order_minhash.FUNCTIONS
    seen, numbered = collections.Counter(), []
    drop = int(order_minhash._PLACE)
    for h in hashes.tolist():
        value = h & ~drop
        numbered.append(int(order_minhash.mix(np.array([(value + seen[value] * int(order_minhash._NEXT)) % 2**64], np.uint64))[0]))
        seen[value] += 1
    out = []
    for factor in order_minhash._FACTORS.tolist():
        order = sorted(range(len(numbered)), key=lambda i: (numbered[i] * factor % 2**64, i))[: order_minhash.CHOSEN]
        value = np.array([len(order)], np.uint64)
        for i in sorted(order):
            value = order_minhash.mix(value * order_minhash._NEXT + hashes[i : i + 1])
        out.append(max(int(value[0]) >> 32, 1))
    return out


def test_order_minhash_is_its_definition(rows):
    for _, text in rows:
        if text and len(text) < 3000:
            assert order_minhash.fingerprint(text).tolist() == plain_fingerprint(text)


def test_order_minhash_of_edited_texts(docs, empty, rows):
    found = order_minhash.edit_fingerprints(docs, "doc_id", "text")
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    line = sorted(rows, key=lambda r: r[0])
    for (i, text), (_, following) in zip(line, line[1:] + line[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r["n_chars"] == len(text)
        if collections.Counter(j for j, _ in rows)[i] == 1:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            mine, changed, after = map(order_minhash.fingerprint, (text, edited, following))
            assert r["fingerprint"] == mine.astype(">u4").tobytes().hex()
            assert r["edited_fingerprint"] == changed.astype(">u4").tobytes().hex()
            assert r["near_edited"] == (mine == changed).mean()
            assert r["near_next"] == (mine == after).mean()
    assert order_minhash.edit_fingerprints(empty, "doc_id", "text").collect() == []


def test_order_matters():
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(30)]
    text, few = "\n".join(lines), "\n".join([*lines[:15], "something else here", *lines[16:]])
    moved = "\n".join(reversed(lines))
    now, edited, shuffled = map(order_minhash.fingerprint, (text, few, moved))
    assert order_minhash.likeness(now, edited) > order_minhash.likeness(now, shuffled) + 0.2
    assert order_minhash.likeness(now, order_minhash.fingerprint(text)) == 1.0


def test_one_row_follows_itself(spark):
    (row,) = order_minhash.edit_fingerprints(table(spark, [(None, "abcdefghijkl")]), "doc_id", "text").collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcdefghiabc").hexdigest()


# --- near duplicates -------------------------------------------------------------


def near_by_brute_force(rows, percent=75):
    word, lower = re.compile(rb"[^\x20\x09-\x0D]+"), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = collections.defaultdict(list)
    for i, text in rows:
        w = word.findall((text or "").encode().translate(lower))
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (sorted(len(s) for s in sets[i]), find(i)) for i in ids}


def check_near(found, rows):
    expected = near_by_brute_force(rows)
    got = collections.defaultdict(list)
    for r in found:
        got[r["doc_id"]].append(r["n_shingles"])
        assert r["component_id"] == expected[r["doc_id"]][1] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert {i: sorted(v) for i, v in got.items()} == {i: v[0] for i, v in expected.items()}


def test_near(docs, empty, rows):
    check_near(near.near_groups(docs, "doc_id", "text").collect(), rows)
    assert near.near_groups(empty, "doc_id", "text").collect() == []


def dense_rows():
    """One large group of near copies, chained, and a passage that many share."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(90), rng.randint(0, 4)):
            text[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    passage = " ".join(base[:40])
    rows += [(1000 + i, passage + " " + " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    return rows


@pytest.mark.parametrize("settled", [near.SETTLED, 500])
def test_near_copies_in_large_nodes(spark, monkeypatch, settled):
    """Small limits, so that nodes branch, stay large at the end and are settled in blocks."""
    monkeypatch.setattr(near, "SMALL", 16)
    monkeypatch.setattr(near, "DEPTH", 2)
    monkeypatch.setattr(near, "SETTLED", settled)
    rows = dense_rows()
    check_near(near.near_groups(table(spark, rows), "doc_id", "text").collect(), rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in list(root) if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- quality and the pipeline -----------------------------------------------------


def test_quality_of_held_out_labels(spark):
    """Fitted on half of the labels, checked on the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    judged = quality.site_quality(docs, known, "doc_id", "text", "source", ["lang"])
    rows = judged.join(labels.where("doc_id % 2 = 1"), judged["doc_id"] == labels["doc_id"]).select("kept", labels["quality"].alias("good")).collect()
    assert sum(r["kept"] == bool(r["good"]) for r in rows) >= 0.97 * len(rows)
    clean = [r for r in rows if r["good"]]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert judged.count() == docs.count()


def test_sparse_sites_are_drawn_to_the_prior(spark):
    rows = [(i, f"fine words in a row number {i}", "big" if i < 200 else None, "x") for i in range(203)]
    bad = [(1000 + i, "!! ## !! ##", "bad", "x") for i in range(200)] + [(2000, "!! ## !! ##", "tiny", None)]
    docs = spark.createDataFrame(rows + bad, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in [*range(0, 200, 5), *range(1000, 1200, 5)]] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    found = {r["doc_id"]: r for r in quality.site_quality(docs, labels, "doc_id", "text", "source", ["lang"]).collect()}
    assert len(found) == len(rows) + len(bad)
    assert all(found[i]["kept"] == (i < 1000) for i in found)
    assert found[0]["host_prior"] > 0.9 > found[1000]["host_prior"] + 0.7
    assert found[1000]["path_prior"] < found[2000]["path_prior"] < found[0]["path_prior"]


def test_posteriors_by_brute_force(spark):
    """Moments, shrinking and posteriors again by loops over documents, with nulls and repeated rows."""
    rng = random.Random(11)
    good, bad = "plain words that make a sentence of some length and sense".split(), "!! ## BUY buy || 99 %% now".split()
    rows = []
    for i in range(160):
        share = rng.random()
        text = " ".join(rng.choice(good if rng.random() < share else bad) for _ in range(rng.randint(1, 40)))
        host = rng.choice(["a", "a", "a", "b", "c", None, f"only-{i}"])
        rows.append((i, None if i % 41 == 0 else text, host, rng.choice(["x", "y", None])))
    rows += rows[:9]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 160, 2)] + [(0, 1), (4, None), (None, 1), (999, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = quality.site_quality(frame, known, "doc_id", "text", "source", ["lang"]).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)

    def described(text):
        data = (text or "").encode()
        return quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]

    lowest = {}
    for i, label in labels:
        if i is not None and label is not None:
            lowest[i] = min(label, lowest.get(i, label))
    x = np.array([described(r[1]) for r in rows])
    fitted = [n for n, r in enumerate(rows) if r[0] in lowest]
    y = np.array([float(lowest[rows[n][0]]) for n in fitted])
    middle, scale = x[fitted].mean(axis=0), x[fitted].std(axis=0) + 1e-9
    weights = quality.fit_logistic((x[fitted] - middle) / scale, y)
    prior = math.log(y.mean() / (1 - y.mean()))
    evidence = [max(-30.0, min(30.0, float(weights[:-1] @ ((v - middle) / scale) + weights[-1] - prior))) for v in x]
    likely = [1 / (1 + math.exp(-e - prior)) for e in evidence]
    mean = sum(likely) / len(likely)
    within = sum((p - mean) ** 2 for p in likely) / len(likely)

    def shrunk(site_of, above):
        members = {}
        for row, p in zip(rows, likely):
            members.setdefault(site_of(row), []).append(p)
        between = sum(len(m) * (sum(m) / len(m) - above(site)) ** 2 for site, m in members.items())
        n = len(rows)
        room = n - sum(len(m) ** 2 for m in members.values()) / n
        spread = max(0.0, (between - (len(members) - 1) * within) / room)
        out = {}
        for site, m in members.items():
            pull = len(m) * spread / (len(m) * spread + within)
            out[site] = above(site) + pull * (sum(m) / len(m) - above(site))
        return out

    hosts = shrunk(lambda r: r[2], lambda site: mean)
    paths = shrunk(lambda r: (r[2], r[3]), lambda site: hosts[site[0]])
    wanted = {}
    for row, e in zip(rows, evidence):
        path = min(max(paths[row[2:]], 1e-6), 1 - 1e-6)
        value = 1 / (1 + math.exp(-e - math.log(path / (1 - path))))
        wanted[row[0]] = (value, e, hosts[row[2]], paths[row[2:]])
    for r in found:
        got = (r["quality"], r["evidence"], r["host_prior"], r["path_prior"])
        assert got == pytest.approx(wanted[r["doc_id"]], rel=1e-5, abs=1e-6)
        assert r["kept"] == (r["quality"] >= 0.5)


def test_quality_without_labels(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert all(r["kept"] for r in quality.site_quality(docs, none, "doc_id", "text", "id", ["node"]).collect())
    assert quality.site_quality(empty, none, "doc_id", "text", "id", []).collect() == []


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before has kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    frames = [docs]
    for n, stage in enumerate(stages):
        df = stage(spark, frames[-1], SF)
        assert n == 4 or df.columns == docs.columns
        df.write.parquet(f"{tmp_path}/{n}")
        frames.append(spark.read.parquet(f"{tmp_path}/{n}"))
    good, one, apart, cut, packed = frames[1:]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in texts(good)}
    assert all((i in kept) == bool(q) for i, q in labels.items() if i in {d for d, _ in texts(docs)})
    assert {i for i, _ in texts(one)} == {i for i, _, _, stays, _ in copies_by_brute_force(texts(good), min) if stays}
    assert {i for i, _ in texts(apart)} == {i for i, (_, c) in near_by_brute_force(texts(one)).items() if i == c}
    expected = removed_by_brute_force(texts(apart), 100)
    assert dict(texts(cut)) == {i: data.decode("utf-8", "ignore") for i, data in expected.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    check_packing(packed.collect(), texts(cut), 1024)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r["ids_crc32"] for r in whole.collect()) == sorted(r["ids_crc32"] for r in packed.collect())


def test_stages_take_odd_rows(spark, rows):
    wide = [(i, t, "en" if i % 2 else None, None if i % 3 else "src", None, "x", 1) for i, t in rows] + [(None, "null id", None, None, None, "x", 1)]
    docs = spark.createDataFrame(wide, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, spans int")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        found = stage(spark, docs, SF)
        assert n == 4 or found.columns == docs.columns
        assert found.count() > 0


def test_uncut_texts_do_not_pass_through_python(spark, tmp_path):
    """Only what was cut is decoded; a null text and one that stays are as they were."""
    line = "é".join(map(str, range(40)))
    docs = spark.createDataFrame(
        [(1, line, len(line)), (2, "x" + line, len(line) + 1), (3, None, 0), (4, "short", 5)], "doc_id bigint, text string, n_chars bigint"
    )
    cut = corpus_pipeline.cut_repeats(spark, docs, str(tmp_path))
    assert "whole_characters(CASE WHEN" in cut._jdf.queryExecution().analyzed().toString()
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert rows == {1: (line, len(line)), 2: ("x", 1), 3: (None, 0), 4: ("short", 5)}


def test_cutting_and_decoding_are_not_in_one_task(spark, tmp_path):
    """Two Python functions in one stage would need two workers for each task."""
    line = "é".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, line, len(line)), (2, "x" + line, len(line) + 1)], "doc_id bigint, text string, n_chars bigint")
    cut = corpus_pipeline.cut_repeats(spark, docs, str(tmp_path))
    assert "FlatMapCoGroups" not in cut._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, cut.collect())) == [(1, line, len(line)), (2, "x", 1)]


def test_powers_are_no_larger_than_asked_for():
    """A worker keeps no tables of two million powers for texts of a few thousand bytes."""
    arrays.give_back()
    values = arrays.byte_values()[np.arange(5000) % 256]
    arrays.span_hashes(values, np.array([0]), np.array([5000]))
    assert 0 < sum(known.nbytes for known in arrays._KNOWN_POWERS.values()) <= 2 * 8 * 8192
    arrays.give_back()
    assert not arrays._KNOWN_POWERS
