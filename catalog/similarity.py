"""Fingerprints, neighbours and example selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    PARTS, Query, SPLIT, documents, fp, h, key, labelled, parts, word_mask,
)
from shotweave.functions.fingerprints import fingerprint, packed_size, tanimoto
from shotweave.functions.text import format_label, label_text
from shotweave.operators.shots import (
    POLICIES, apply_shortfall, pool_rows, random_shots, select_shots, shots_array,
)
from shotweave.operators.similarity import build_index, candidate_pool, knn, neighbour_rows
from shotweave.plans.records import Masking, prepare_classification


def _prepared(spark, sf):
    """All rows of the split task with fingerprints, and its train rows."""
    split = prepare_classification(labelled(spark, sf), "text", "label", "source")
    rows = build_index(split.withColumn("output", label_text(F.col("label"))), "text")
    return rows, rows.where(F.col("split") == "train")


def _rounded(rows):
    return rows.withColumn("similarity", F.round("similarity", 6))


def fingerprints(spark, sf):
    found = documents(spark, sf).select("row_id", fingerprint(F.col("text")).alias("fp"))
    return found.select(
        "row_id", F.size("fp").alias("n_bits"), F.array_join("fp", ",").alias("bits")
    )


def char_fingerprints(spark, sf):
    """Runs of three characters, the form for texts without blanks."""
    bits = fingerprint(F.col("text"), size=3, unit="char")
    return parts(spark, sf).select("row_id", F.array_join(bits, ",").alias("bits"))


def similarity_pairs(spark, sf):
    """Every document with the one that follows it."""
    d = documents(spark, sf).select("row_id", fingerprint(F.col("text")).alias("fp"))
    after = d.select((F.col("row_id") - 1).alias("row_id"), F.col("fp").alias("next_fp"))
    pairs = d.join(after, "row_id")
    return pairs.select("row_id", F.round(tanimoto(F.col("fp"), F.col("next_fp")), 6).alias("similarity"))


def index_rows(spark, sf):
    d = documents(spark, sf).select("row_id", "text")
    return build_index(d, "text").select("row_id", packed_size(F.col("packed")).cast("bigint").alias("n_bits"))


def knn_train(spark, sf):
    """Three nearest train rows of every row; a train row finds itself."""
    rows, train = _prepared(spark, sf)
    return _rounded(neighbour_rows(knn(rows, train, 3)))


def knn_leave_one_out(spark, sf):
    rows = build_index(parts(spark, sf), "text")
    return _rounded(neighbour_rows(knn(rows, rows, 3, exclude_self=True)))


def _pool(spark, sf):
    rows, train = _prepared(spark, sf)
    asked = rows.where(F.col("split") != "train")
    return pool_rows(candidate_pool(asked, train), train, "output"), train


def pools(spark, sf):
    return _rounded(_pool(spark, sf)[0].drop("label"))


def _selected(strategy: str, k: int) -> Query:
    def run(spark, sf):
        return select_shots(_pool(spark, sf)[0], strategy, k)

    return run


def shots_anywhere(spark, sf):
    rows = parts(spark, sf)
    return random_shots(rows, rows, 2)


def shortfalls(spark, sf):
    """What each policy makes of neighbours closer than 0.12, five asked for."""
    rows, train = _prepared(spark, sf)
    near = neighbour_rows(knn(rows, train, 5)).where(F.col("similarity") >= 0.12)
    listed = shots_array(near, train, "text", "output")
    joined = rows.select("row_id").join(listed.withColumnRenamed("query_id", "row_id"), "row_id", "left")
    frames = [
        apply_shortfall(joined, 5, policy).select(
            F.lit(policy).alias("policy"), "row_id", F.size("shots").alias("shown"),
            (F.col("keep_stored") if policy == "keep_instruction" else F.lit(False)).alias("keep_stored"),
        )
        for policy in POLICIES
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _array(text_form: str) -> Query:
    def run(spark, sf):
        masking = Masking()
        source = parts(spark, sf).withColumn("tokens", masking.tokenise(F.col("text")))
        rows = build_index(
            source.withColumn("stored", masking.apply(F.col("text"), F.col("row_id"), "query")), "text"
        )
        near = neighbour_rows(knn(rows, rows, 2, exclude_self=True))
        form = {
            "fresh": masking.apply(F.col("text"), F.col("query_id"), "shot", F.col("neighbour_id")),
            "stored": F.col("stored"), "original": F.col("text"),
        }[text_form]
        listed = shots_array(near, rows, form, format_label(F.col("label")))
        lines = F.transform("shots", lambda s: F.concat(s["text"], F.lit(" = "), s["label"]))
        return listed.select("query_id", F.array_join(lines, " | ").alias("shots"))

    return run


QUERIES: dict[str, Query] = {
    "fingerprint": fingerprints,
    "fingerprint_chars": char_fingerprints,
    "tanimoto_pairs": similarity_pairs,
    "fp_index": index_rows,
    "knn_train": knn_train,
    "knn_leave_one_out": knn_leave_one_out,
    "candidate_pool": pools,
    "shots_similarity": _selected("similarity", 3),
    "shots_diversity": _selected("diversity", 5),
    "shots_random_pool": _selected("random", 3),
    "shots_random_global": shots_anywhere,
    "shortfall_policies": shortfalls,
    "shots_array_fresh": _array("fresh"),
    "shots_array_stored": _array("stored"),
    "shots_array_original": _array("original"),
}

FP = f"""{SPLIT},
fps AS (SELECT *, {fp('text')} AS fp, CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS output FROM split_rows
  WHERE {fp('text')} IS NOT NULL)"""


def neighbours(queries: str, index: str, k: int, extra: str = "true") -> str:
    """CTE ``near``: ranked neighbours of all pairs."""
    return f"""
shared AS (
  SELECT q.row_id AS query_id, c.row_id AS neighbour_id, len(q.fp) AS a, len(c.fp) AS b,
    len(list_intersect(q.fp, c.fp)) AS s
  FROM {queries} q, {index} c WHERE {extra}),
near AS (
  SELECT * FROM (
    SELECT query_id, neighbour_id, s / (a + b - s) AS similarity,
      row_number() OVER (PARTITION BY query_id ORDER BY s / (a + b - s) DESC, neighbour_id)::INTEGER AS rank
    FROM shared) WHERE rank <= {k})"""


# Most parts share their words with many others: compare distinct sets once.
PART_NEAR = f"""{PARTS},
pfps AS (SELECT *, {fp('text')} AS fp FROM parts),
sets AS (SELECT fp, min(row_id) AS set_id FROM pfps GROUP BY fp),
members AS (SELECT row_id, set_id FROM pfps JOIN sets USING (fp)),
set_pairs AS (
  SELECT q.set_id AS a, c.set_id AS b,
    len(list_intersect(q.fp, c.fp)) / (len(q.fp) + len(c.fp) - len(list_intersect(q.fp, c.fp))) AS similarity
  FROM sets q, sets c),
near AS (
  SELECT * FROM (
    SELECT q.row_id AS query_id, c.row_id AS neighbour_id, similarity,
      row_number() OVER (PARTITION BY q.row_id ORDER BY similarity DESC, c.row_id)::INTEGER AS rank
    FROM members q JOIN set_pairs p ON p.a = q.set_id JOIN members c ON c.set_id = p.b
    WHERE q.row_id <> c.row_id) WHERE rank <= 3)"""

TRAIN_NEAR = f"""{FP}, train AS (SELECT * FROM fps WHERE split = 'train'),
asked AS (SELECT * FROM fps WHERE split <> 'train'), {neighbours('asked', 'train', 50)},
pool AS (SELECT n.*, t.output AS label, {h("'42:pick:' || query_id || ':' || neighbour_id")} AS chance,
    {h("'42:order:' || query_id || ':' || neighbour_id")} AS shuffle
  FROM near n JOIN train t ON t.row_id = n.neighbour_id)"""

_ORDERED = "row_number() OVER (PARTITION BY query_id ORDER BY shuffle, neighbour_id)::INTEGER AS rank"


def _array_sql(form: str) -> str:
    return f"""WITH {PART_NEAR}
      SELECT query_id, string_agg({form} || ' = ' || printf('%.4f', label), ' | ' ORDER BY rank) AS shots
      FROM near JOIN parts p ON p.row_id = neighbour_id WHERE rank <= 2 GROUP BY query_id"""


ORACLES: dict[str, str] = {
    "fingerprint": f"""WITH f AS (SELECT doc_id AS row_id, {fp('text')} AS fp FROM documents)
      SELECT row_id, len(fp)::INTEGER AS n_bits, array_to_string(fp, ',') AS bits FROM f""",
    "fingerprint_chars": f"""WITH {PARTS}, k AS (SELECT row_id, {key('text')} AS t FROM parts),
      runs AS (SELECT DISTINCT row_id, substr(t, i, 3) AS s
        FROM (SELECT *, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM k)),
      bits AS (SELECT DISTINCT row_id, {h('s')} % 2048 AS b FROM runs)
      SELECT row_id, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits FROM bits GROUP BY 1""",
    "tanimoto_pairs": f"""WITH f AS (SELECT doc_id AS row_id, {fp('text')} AS fp FROM documents)
      SELECT a.row_id, round(len(list_intersect(a.fp, b.fp)) /
        (len(a.fp) + len(b.fp) - len(list_intersect(a.fp, b.fp))), 6) AS similarity
      FROM f a JOIN f b ON b.row_id = a.row_id + 1""",
    "fp_index": f"""SELECT doc_id AS row_id, len({fp('text')}) AS n_bits FROM documents
      WHERE {fp('text')} IS NOT NULL""",
    "knn_train": f"""WITH {FP}, train AS (SELECT * FROM fps WHERE split = 'train'),
      {neighbours('fps', 'train', 3)}
      SELECT query_id, rank, neighbour_id, round(similarity, 6) AS similarity FROM near""",
    "knn_leave_one_out": f"""WITH {PART_NEAR}
      SELECT query_id, rank, neighbour_id, round(similarity, 6) AS similarity FROM near""",
    "candidate_pool": f"""WITH {TRAIN_NEAR}
      SELECT query_id, rank, neighbour_id, round(similarity, 6) AS similarity FROM pool""",
    "shots_similarity": f"WITH {TRAIN_NEAR} SELECT query_id, rank, neighbour_id FROM pool WHERE rank <= 3",
    "shots_diversity": f"""WITH {TRAIN_NEAR},
      drawn AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, label ORDER BY chance, neighbour_id) AS n
        FROM pool)
      SELECT query_id, {_ORDERED}, neighbour_id FROM drawn WHERE n <= CASE WHEN label = 'Yes' THEN 3 ELSE 2 END""",
    "shots_random_pool": f"""WITH {TRAIN_NEAR},
      drawn AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY chance, neighbour_id) AS n,
          count(*) OVER (PARTITION BY query_id) AS size FROM pool)
      SELECT query_id, {_ORDERED}, neighbour_id FROM drawn WHERE n <= 3 AND size >= 3""",
    "shots_random_global": f"""WITH numbered AS (
        SELECT p_partkey AS neighbour_id, row_number() OVER (ORDER BY p_partkey) - 1 AS position,
          count(*) OVER () AS n FROM part),
      first AS (SELECT neighbour_id AS query_id, n, {h("'42:position:0:' || neighbour_id")} % (n - 1) AS a,
          {h("'42:position:1:' || neighbour_id")} % n AS b FROM numbered WHERE n >= 2),
      drawn AS (SELECT query_id, unnest([a, CASE WHEN a = b THEN n - 1 ELSE b END]) AS position FROM first),
      found AS (SELECT query_id, neighbour_id, {h("'42:order:' || query_id || ':' || neighbour_id")} AS shuffle
        FROM drawn JOIN numbered USING (position))
      SELECT query_id, {_ORDERED}, neighbour_id FROM found""",
    "shortfall_policies": f"""WITH {FP}, train AS (SELECT * FROM fps WHERE split = 'train'),
      {neighbours('fps', 'train', 5)},
      found AS (SELECT f.row_id, count(n.query_id)::INTEGER AS c
        FROM fps f LEFT JOIN near n ON n.query_id = f.row_id AND n.similarity >= 0.12 GROUP BY 1)
      SELECT 'use_what_is_there' AS policy, row_id, c AS shown, false AS keep_stored FROM found
      UNION ALL SELECT 'drop_query', row_id, c, false FROM found WHERE c >= 5
      UNION ALL SELECT 'keep_instruction', row_id, CASE WHEN c < 5 THEN 0 ELSE c END, c < 5 FROM found
      UNION ALL SELECT 'zero_shot', row_id, CASE WHEN c < 5 THEN 0 ELSE c END, false FROM found""",
    "shots_array_fresh": _array_sql(word_mask("text", "'42:' || query_id || ':shot:' || neighbour_id")[0]),
    "shots_array_stored": _array_sql(word_mask("text", "'42:' || neighbour_id || ':query'")[0]),
    "shots_array_original": _array_sql("text"),
}
