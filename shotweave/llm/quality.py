"""Document quality: a classifier's evidence with posteriors of sites, by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.arrays import blocks, text_buffer, tidy
from shotweave.llm.language import words
from shotweave.storage import fits_broadcast, materialise

#: Labelled documents that the classifier is fitted on at most.
LABELLED = 20_000

_LETTERS = ((65, 90), (97, 122))
FEATURES = [
    "upper", "digit", "space", "newline", "beyond_ascii", "bang", "bar", "decoration", "stop", "other",
    "word_length", "long_words", "same_as_before", "same_as_two_before", "new_words", "few_words",
]

#: Bytes of text that are described at once; some ten arrays of eight bytes a byte are made of them.
SMALL_BLOCK = 1 << 19


def _classes() -> np.ndarray:
    """Number of the counted class of each byte; 10 is a plain small letter."""
    table = np.full(256, 9, np.uint8)
    table[97:123] = 10
    table[65:91] = 0
    table[48:58] = 1
    table[[32, 9, 11, 12, 13]] = 2
    table[10] = 3
    table[128:] = 4
    table[[ord("!"), ord("?")]] = 5
    table[ord("|")] = 6
    table[[ord(c) for c in "%&*$#@~^=+<>{}[]\\"]] = 7
    table[[ord(c) for c in ".,;:'\"-()"]] = 8
    return table


_TABLE = _classes()


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of shares for each text; an empty text is all zero but for its shortness."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    kind = _TABLE[raw].astype(np.int64) + np.repeat(np.arange(n), sizes) * 11
    shares = np.bincount(kind, minlength=11 * n).reshape(n, 11)[:, :10] / np.maximum(sizes, 1)[:, None]
    keys, _, at = words(raw, offsets)
    owner = np.repeat(np.arange(n), np.diff(at))
    inner = np.ones(len(keys), bool)
    inner[at[1:] - 1] = False  # ends
    keys, owner = keys[inner], owner[inner]
    count = np.bincount(owner, minlength=n)
    per_word = np.maximum(count, 1)

    def share(flags: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.bincount(who, flags, n) / per_word

    same = [share((keys[k:] == keys[:-k]) & (owner[k:] == owner[:-k]), owner[k:]) for k in (1, 2)]
    order = np.lexsort((keys, owner))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    letters = sizes * (1 - shares[:, 2] - shares[:, 3])
    length = letters / per_word
    return np.column_stack([
        shares, length / 10, np.minimum(length / 10, 5) ** 2, *same,
        share(new, owner[order]), 1 / (1 + count),
    ])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


def _shrunk(units: DataFrame, prior: str, within: float, spread: float, name: str) -> DataFrame:
    """Posterior mean of each unit: its own mean where it has many documents, else its prior."""
    weight = F.col("n") * spread / (F.col("n") * spread + within) if spread > 0 else F.lit(0.0)
    return units.withColumn(name, F.col(prior) + weight * (F.col("total") / F.col("n") - F.col(prior)))


def _spread(units: DataFrame, prior: str, within: float) -> float:
    """Variance between units beyond what their documents explain, by moments."""
    deviation = F.col("total") / F.col("n") - F.col(prior)
    row = units.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * deviation * deviation).alias("between"), F.count("*").alias("units"),
    ).first()
    if not row["n"] or row["units"] < 2:
        return 0.0
    room = row["n"] - row["squares"] / row["n"]
    return max(0.0, (row["between"] - (row["units"] - 1) * within) / room) if room > 0 else 0.0


def site_quality(
    df: DataFrame, labels: DataFrame, doc_id: str, text: str, host: str, path: list[str],
    label: str = "quality", threshold: float = 0.5, labelled: int = LABELLED,
) -> DataFrame:
    """Posterior quality of every document from its text and where it comes from.

    A logistic regression on shares of bytes and words gives a document's
    evidence, the log-likelihood ratio of good to bad.  It is fitted on at most
    ``labelled`` documents with a label, chosen by a hash of the id.  Sums of
    the classifier's probabilities over all documents give a mean for each host
    and for each path (``host`` and the columns of ``path``).  Means of a host
    are shrunk toward the global mean, means of a path toward its host, by the
    variances that the moments of the groups show.  A document's posterior joins
    its evidence and its path's posterior; it is kept from ``threshold`` on.

    Returns doc_id, quality, evidence, host_prior, path_prior, kept.  Only
    numbers and site names are shuffled, summed per task first, so a host with a
    third of all documents is one row per task.  Null texts are empty texts;
    null hosts and path parts are sites of their own; ids labelled more than
    once count by their lowest label.  With labels of one class, or none, the
    evidence is 0 and every document is kept.  Repeated rows give repeated
    results; an empty table gives none; other columns are not looked at.
    """
    spark = df.sparkSession
    site = [F.coalesce(df[c].cast("string"), F.lit("\0")).alias(f"site_{i}") for i, c in enumerate([host, *path])]
    names = [f"site_{i}" for i in range(len(site))]
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"), *site)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets, SMALL_BLOCK):
                x = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], flat], names=schema.names)

    described = materialise(rows.mapInArrow(tidy(describe), schema), "features")
    known = (
        labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("double").alias("y"))
        .dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    )
    sample = described.select("doc_id", "x").join(known, "doc_id").limit(labelled).collect()
    width = len(FEATURES)
    x = np.array([r["x"] for r in sample]).reshape(-1, width)
    y = np.array([r["y"] for r in sample])
    if len(set(y.tolist())) == 2:
        middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        fitted = fit_logistic((x - middle) / scale, y)
        weights, bias = fitted[:-1] / scale, fitted[-1] - float((fitted[:-1] * middle / scale).sum())
        prior = float(np.log(y.mean() / (1 - y.mean())))
    else:
        weights, bias, prior = np.zeros(width), 0.0, 0.0
    product = F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    evidence = F.aggregate(product, F.lit(bias - prior), lambda s, v: s + v)
    judged = described.select("doc_id", *names, F.greatest(F.least(evidence, F.lit(30.0)), F.lit(-30.0)).alias("evidence"))
    if len(set(y.tolist())) != 2:
        return judged.select(
            "doc_id", F.lit(1.0).alias("quality"), "evidence", F.lit(1.0).alias("host_prior"),
            F.lit(1.0).alias("path_prior"), F.lit(True).alias("kept"),
        )
    likely = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    paths = materialise(
        judged.groupBy(*names).agg(
            F.count("*").alias("n"), F.sum(likely).alias("total"), F.sum(likely * likely).alias("squares")
        ),
        "paths",
    )
    overall = paths.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).first()
    if not overall["n"]:
        mean, within = 0.5, 0.0
    else:
        mean = overall["total"] / overall["n"]
        within = max(overall["squares"] / overall["n"] - mean * mean, 1e-6)
    hosts = (
        paths.groupBy("site_0").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .withColumn("global", F.lit(float(mean)))
    )
    hosts = _shrunk(hosts, "global", within, _spread(hosts, "global", within), "host_prior")
    placed = paths.join(hosts.select("site_0", "host_prior"), "site_0")
    placed = materialise(_shrunk(placed, "host_prior", within, _spread(placed, "host_prior", within), "path_prior"), "sites")
    priors = placed.select(*names, "host_prior", "path_prior")
    if fits_broadcast(priors):
        priors = F.broadcast(priors)
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_prior")))))
    return judged.join(priors, names).select(
        "doc_id", posterior.alias("quality"), "evidence", "host_prior", "path_prior", (posterior >= threshold).alias("kept")
    )
