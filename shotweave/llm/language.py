"""A gated recurrent language model and its score of whole documents.

Tokens are lower-cased words and one end for each text.  The model predicts the
class of the next token from a recurrent state and the token from its class:
frequent words are classes of their own, all others fall in classes by their
last letters and are told apart by their corpus counts there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.arrays import byte_values, columns, from_columns, mix, span_hashes, text_buffer
from shotweave.llm.groups import BLOBS, blob_rows, group_count, tree_merge
from shotweave.storage import materialise

#: Classes of one frequent token each, and classes by the last letters.
HEAD, CUES = 32, 96
CLASSES = HEAD + CUES
STATE = 16
#: Steps that gradients go back.
WINDOW = 24
ROUNDS = 2
LANES, SCORED = 64, 512
#: Rows of classes looked at at once: they stay in a core's cache.
ROWS = 512
_END = np.uint64(0xE17D)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and cue of every token of some texts, and n + 1 offsets; each text ends in an end."""
    lower = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    word = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    start, stop = word.copy(), word.copy()
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    start[1:] &= ~word[:-1] | cut[1:-1]
    stop[:-1] &= ~word[1:] | cut[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    keys = _word_hashes(lower, start, stop)
    tail = lower[stop - 1].astype(np.uint64)
    for back in (2, 3):
        tail = tail << np.uint64(8) | np.where(stop - back >= start, lower[np.maximum(stop - back, 0)], 0).astype(np.uint64)
    cues = (mix(tail) % np.uint64(CUES)).astype(np.uint8)
    counts = np.searchsorted(start, offsets)
    at = counts + np.arange(len(offsets))
    ends = at[1:] - 1
    out, cue = np.full(at[-1], _END, np.uint64), np.zeros(at[-1], np.uint8)
    inner = np.ones(at[-1], bool)
    inner[ends] = False
    out[inner], cue[inner] = keys, cues
    return out, cue, at


def _word_hashes(lower: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """Hashes of words, a stretch of text at a time: they take 40 times its room."""
    keys, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + size, "right")))
        begin = start[i]
        keys[i:j] = span_hashes(byte_values()[lower[begin : stop[j - 1]]], start[i:j] - begin, stop[i:j] - begin)
        i = j
    return keys


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending keys by part, and where each part begins."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


# --- the network --------------------------------------------------------------


def new_weights(class_share: np.ndarray) -> list[np.ndarray]:
    """Input table, recurrent matrix, output matrix and output bias."""
    rng = np.random.default_rng(7)
    return [
        (rng.standard_normal((CLASSES, 3 * STATE)) * 0.3).astype(np.float32),
        (rng.standard_normal((STATE, 3 * STATE)) / np.sqrt(STATE)).astype(np.float32),
        (rng.standard_normal((STATE, CLASSES)) * 0.1).astype(np.float32),
        np.log(class_share).astype(np.float32),
    ]


def _roll(weights, x: np.ndarray, h: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """States before and after every step, both gates, fresh states and their recurrent parts.

    Where ``mask`` is false the state stays.  All arrays are made once and filled
    step by step; a gate is (tanh(x / 2) + 1) / 2, and the weights are halved before.
    """
    table, recurrent = weights[:2]
    steps, lanes = x.shape
    two, half = 2 * STATE, table.dtype.type(0.5)
    by_gates, by_fresh = recurrent[:, :two] * half, np.ascontiguousarray(recurrent[:, two:])
    gates, fresh = (table[:, :two] * half).take(x, axis=0), np.ascontiguousarray(table[:, two:]).take(x, axis=0)
    old, states = np.empty_like(fresh), np.empty((steps + 1, lanes, STATE), table.dtype)
    states[0], inner = h, np.empty((lanes, two), table.dtype)
    stays = np.zeros(steps, bool) if mask is None else ~mask.all(axis=1)
    for t in range(steps):
        h, new, gate, made, part = states[t], states[t + 1], gates[t], fresh[t], old[t]
        gate += np.matmul(h, by_gates, out=inner)
        np.tanh(gate, out=gate)
        gate *= half
        gate += half
        np.matmul(h, by_fresh, out=part)
        made += np.multiply(gate[:, STATE:], part, out=new)
        np.tanh(made, out=made)
        np.subtract(h, made, out=new)
        new *= gate[:, :STATE]
        new += made
        if stays[t]:
            np.copyto(new, h, where=~mask[t][:, None])
    return states, gates, fresh, old


def _step(weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    states, *rest = (a[-1] for a in _roll(weights, x[None], h))
    return states, *rest


def _with_one(hidden: np.ndarray) -> np.ndarray:
    """A last column of ones, which the bias belongs to."""
    both = np.ones((len(hidden), STATE + 1), hidden.dtype)
    both[:, :STATE] = hidden
    return both


def _likely(hidden: np.ndarray, weights, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log-likelihood (nats) of the targets; exponentials of all classes and their sums.

    ``hidden`` has its column of ones.  States are below one, so the weights say
    how far from zero a row can get; only beyond what exp can take are its maxima
    taken off.
    """
    out = np.vstack([weights[2], weights[3]])
    error = hidden @ out
    if np.abs(out).sum(axis=0).max() > 60:
        error -= error.max(axis=1, keepdims=True)
    likely = error[np.arange(len(error)), y]
    np.exp(error, out=error)
    total = error @ np.ones(CLASSES, error.dtype)
    return likely - np.log(total), error, total


def _by_class(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each class."""
    sums, size = np.zeros((CLASSES, rows.shape[1]), rows.dtype), np.bincount(x, minlength=CLASSES)
    order = np.argsort(x.astype(np.uint8), kind="stable")
    there = np.flatnonzero(size)
    sums[there] = np.add.reduceat(rows.take(order, axis=0), (np.cumsum(size) - size)[there], axis=0)
    return sums


def window_loss(weights, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray):
    """Log-likelihood (nats), gradients and last state of one (steps, lanes) window."""
    recurrent, out = weights[1:3]
    steps, lanes = x.shape
    states, gates, fresh, old = _roll(weights, x, h, mask)
    hidden, flat = _with_one(states[1:].reshape(steps * lanes, STATE)), mask.ravel()
    likely, counted = 0.0, max(int(flat.sum()), 1)
    from_out, to_out = np.empty((len(hidden), STATE), hidden.dtype), np.zeros((STATE + 1, CLASSES), hidden.dtype)
    for i in range(0, len(hidden), ROWS):
        rows, some = slice(i, i + ROWS), hidden[i : i + ROWS]
        of_each, error, total = _likely(some, weights, y.ravel()[rows])
        likely += float((of_each * flat[rows]).sum())
        # Rows are divided by their sums where they are narrow.
        error[np.arange(len(some)), y.ravel()[rows]] -= total
        share = (flat[rows] / (total * counted)).astype(error.dtype)[:, None]
        np.multiply(error @ out.T, share, out=from_out[rows])
        to_out += (error.T @ (some * share)).T
    from_out = from_out.reshape(steps, lanes, STATE)
    # What does not depend on later steps is taken for all steps at once.
    keep, reset = gates[:, :, :STATE], gates[:, :, STATE:]
    # Per step: the parts for keep, reset and the recurrent part of fresh.
    factors = np.empty((steps, lanes, 3, STATE), hidden.dtype)
    to_fresh = (1 - keep) * (1 - fresh * fresh)
    np.multiply((states[:-1] - fresh) * keep, 1 - keep, out=factors[:, :, 0])
    np.multiply(to_fresh, reset, out=factors[:, :, 2])
    np.multiply(factors[:, :, 2] * old, 1 - reset, out=factors[:, :, 1])
    full = mask.all(axis=1)
    heres, later = np.empty_like(from_out), np.zeros((lanes, STATE), from_out.dtype)
    back, part = np.ascontiguousarray(recurrent.T), np.empty((lanes, 3, STATE), hidden.dtype)
    for t in reversed(range(steps)):
        here = np.add(later, from_out[t], out=heres[t])
        passed = None
        if not full[t]:
            passed = np.where(mask[t][:, None], 0, here)
            here *= mask[t][:, None]
        np.multiply(factors[t], here[:, None, :], out=part)
        np.matmul(part.reshape(lanes, 3 * STATE), back, out=later)
        later += here * keep[t]
        if passed is not None:
            later += passed
    factors *= heres[:, :, None, :]
    inner = factors.reshape(steps * lanes, 3 * STATE)
    to_recurrent = states[:-1].reshape(steps * lanes, STATE).T @ inner
    np.multiply(heres, to_fresh, out=factors[:, :, 2])
    return likely, [_by_class(x.ravel(), inner), to_recurrent, to_out[:STATE], to_out[STATE]], states[-1]


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def apply(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for w, g, m, s in zip(self.weights, grads, self.mean, self.square):
            g = g * scale
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-8)


def _windows(texts: list[np.ndarray], begin: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and mask of one window of each text."""
    x = np.zeros((steps, len(texts)), np.int64)
    y, mask = np.zeros_like(x), np.zeros(x.shape, bool)
    for lane, text in enumerate(texts):
        part = text[begin : begin + steps]
        y[: len(part), lane] = part
        mask[: len(part), lane] = True
        if begin:
            x[: len(part), lane] = text[begin - 1 : begin + len(part) - 1]
        else:
            x[1 : len(part), lane] = part[:-1]
    return x, y, mask


def train(weights: list[np.ndarray], texts: list[np.ndarray], order_seed: int, rate: float = 0.01) -> int:
    """Improve the weights in place by truncated backpropagation; tokens trained on.

    Every window of every text counts, in order; the state goes on from one to
    the next.  Groups of texts come in an order drawn from ``order_seed``.
    """
    order = sorted(texts, key=len)
    adam, seen = Adam(weights, rate), 0
    lanes = [order[i : i + LANES] for i in range(0, len(order), LANES)]
    for i in np.random.default_rng(order_seed).permutation(len(lanes)):
        group = lanes[i]
        state = np.zeros((len(group), STATE), np.float32)
        for begin in range(0, len(group[-1]), WINDOW):
            alive = next(j for j, text in enumerate(group) if len(text) > begin)
            group, state = group[alive:], state[alive:]
            x, y, mask = _windows(group, begin, min(WINDOW, len(group[-1]) - begin))
            _, grads, state = window_loss(weights, x, y, mask, state)
            adam.apply(grads)
            seen += int(mask.sum())
    return seen


def score(weights: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Log10-likelihood of the classes of whole texts, state carried throughout."""
    scores = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for a in range(0, len(order), SCORED):
        lanes = order[a : a + SCORED]
        state, begin, longest = np.zeros((len(lanes), STATE), np.float32), 0, len(texts[lanes[-1]])
        while begin < longest:
            alive = next(j for j, i in enumerate(lanes) if len(texts[i]) > begin)
            lanes, state = lanes[alive:], state[alive:]
            steps = min(WINDOW, longest - begin)
            x, y, mask = _windows([texts[i] for i in lanes], begin, steps)
            states = _roll(weights, x, state)[0]
            hidden, state = _with_one(states[1:].reshape(-1, STATE)), states[-1]
            likely = np.empty(len(hidden), hidden.dtype)
            for i in range(0, len(hidden), ROWS):
                likely[i : i + ROWS] = _likely(hidden[i : i + ROWS], weights, y.ravel()[i : i + ROWS])[0]
            scores[lanes] += np.where(mask, likely.reshape(mask.shape), 0).sum(axis=0, dtype=np.float64)
            begin += steps
    return scores / np.log(10)


# --- on Spark -----------------------------------------------------------------


def _merge_counts(blobs: list[bytes]) -> bytes:
    """Token totals, counts and types by cue, and the most frequent keys."""
    parts = [from_columns(b) for b in blobs]
    totals, by_cue = sum(p[0] for p in parts), sum(p[1] for p in parts)
    keys, cues, counts = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    best = np.lexsort((keys, -counts))[:HEAD]
    return columns(totals, by_cue, keys[best], cues[best], counts[best])


def _merge_weights(blobs: list[bytes]) -> bytes:
    """Mean of weights, each in proportion to the tokens it has seen."""
    parts = [from_columns(b) for b in blobs]
    seen = sum(float(p[0][0]) for p in parts)
    if not seen:
        return blobs[0]
    mean = [sum(p[i].astype(np.float64) * (float(p[0][0]) / seen) for p in parts) for i in range(1, 5)]
    return columns(np.array([seen]), *[m.astype(np.float32) for m in mean])


def _unpack(blob: bytes) -> list[np.ndarray]:
    shapes = [(CLASSES, 3 * STATE), (STATE, 3 * STATE), (STATE, CLASSES), (CLASSES,)]
    return [a.reshape(s).copy() for a, s in zip(from_columns(blob)[1:], shapes)]


def log_likelihoods(df: DataFrame, doc_id: str, text: str, held_out) -> DataFrame:
    """Score every whole text; learn from those that ``held_out`` is not true of.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    add-one unigram) and score (the network), both as log10 probabilities.

    Counts: each group of documents sends every distinct word once, with its
    count, to the part its hash belongs to; parts send sums back in the same
    order, so no word string and no row per token is shuffled.  A unigram key is
    a 64-bit hash.  Training: every group of training documents improves a copy
    of the weights; copies are averaged in a tree, and again from there,
    ``ROUNDS`` times.  Every token of all training documents takes part in every
    round, whatever the size.

    Null text is empty: its only token is the end.  A null id counts as
    training.  Repeated rows count as often as they come.  Without training
    tokens scores come from the initial weights.  An empty table gives no rows;
    other columns are not looked at.
    """
    parts = group_count(df, text)
    docs = df.select(
        df[doc_id].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), df[text].alias("text"),
        F.pmod(F.xxhash64(df[doc_id], df[text]), F.lit(parts)).cast("int").alias("bucket"),
    )

    def tokens(table: pa.Table):
        return words(*text_buffer(table["text"].combine_chunks()))

    def ask(table: pa.Table) -> pa.Table:
        keys, cues, at = tokens(table)
        learn = np.repeat(~np.asarray(table["held_out"].combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(at))
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, learn, len(distinct)).astype(np.uint32)
        order, cut = _by_part(distinct, parts)
        own = np.array([table["bucket"][0].as_py()], np.int32)
        rows = [
            (p, columns(own, distinct[m], cues[index[m]], counts[m]))
            for p in range(parts) if len(m := order[cut[p] : cut[p + 1]])
        ]
        return pa.Table.from_batches([blob_rows(rows)])

    def answer(table: pa.Table) -> pa.Table:
        part = table["bucket"][0].as_py()
        asked = [from_columns(b) for b in table["blob"].to_pylist()]
        keys, cues, counts = (np.concatenate([a[i] for a in asked]) for i in (1, 2, 3))
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        back, at, rows = sums[inverse].astype(np.uint32), 0, []
        for own, key, *_ in asked:
            rows.append((int(own[0]), columns(np.array([part]), back[at : at + len(key)])))
            at += len(key)
        cue = cues[index]
        plain = distinct != _END
        by_cue = np.stack([
            np.bincount(cue[plain], sums[plain], CUES), np.bincount(cue[plain], sums[plain] > 0, CUES)
        ]).astype(np.int64).ravel()
        best = np.flatnonzero(plain & (sums > 0))
        best = best[np.lexsort((distinct[best], -sums[best]))[:HEAD]]
        totals = np.array([sums.sum(), (sums > 0).sum()])
        rows.append((-1 - part, columns(totals, by_cue, distinct[best], cue[best], sums[best])))
        return pa.Table.from_batches([blob_rows(rows)])

    answers = materialise(
        docs.groupBy("bucket").applyInArrow(ask, BLOBS).groupBy("bucket").applyInArrow(answer, BLOBS), "counts"
    )
    summed = tree_merge(
        answers.where("bucket < 0").select((-1 - F.col("bucket")).cast("int").alias("bucket"), "blob"), _merge_counts
    )
    if summed is None:
        return df.sparkSession.createDataFrame(
            [], "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double"
        )
    (n_train, n_types), by_cue, head, head_cue, head_count = from_columns(summed)
    head, head_cue, head_count = head[: HEAD - 1], head_cue[: HEAD - 1], head_count[: HEAD - 1]
    mass, types = by_cue.reshape(2, CUES).copy()
    np.subtract.at(mass, head_cue, head_count)
    np.subtract.at(types, head_cue, 1)
    room = mass + types + 1  # one more for what is not known
    head_order = np.argsort(head)
    sorted_head = head[head_order]
    ends = n_train - by_cue[:CUES].sum()
    share = np.full(CLASSES, 1.0)
    share[0] += ends
    share[1 : 1 + len(head)] += head_count
    share[HEAD:] += mass
    floor = float(n_train + n_types + 1)

    sequences = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
        "within double, classes binary"
    )

    def look_up(table: pa.Table, back: pa.Table) -> pa.Table:
        keys, cues, at = tokens(table)
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        order, _ = _by_part(distinct, parts)
        got = sorted((from_columns(b) for b in back["blob"].to_pylist()), key=lambda g: int(g[0][0]))
        count = np.zeros(len(distinct), np.int64)
        if got:
            count[order] = np.concatenate([g[1] for g in got])
        cue = cues[index].astype(np.int64)
        kind = HEAD + cue
        within = np.log10((count + 1) / room[cue])
        if len(sorted_head):
            place = np.minimum(np.searchsorted(sorted_head, distinct), len(sorted_head) - 1)
            is_head = sorted_head[place] == distinct
            kind[is_head], within[is_head] = 1 + head_order[place[is_head]], 0.0
        kind[distinct == _END], within[distinct == _END] = 0, 0.0
        begin = at[:-1]
        classes = kind[inverse].astype(np.uint8).tobytes()
        base = np.log10((count + 1) / floor)
        sums = [np.add.reduceat(v[inverse], begin) if len(begin) else v[:0] for v in ((count > 0).astype(np.int64), base, within)]
        cut = at.tolist()
        return pa.table({
            "doc_id": table["doc_id"].cast(pa.int64()), "held_out": table["held_out"], "n_tokens": pa.array(np.diff(at)),
            "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "within": pa.array(sums[2]),
            "classes": pa.array([classes[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
        })

    looked_up = materialise(
        docs.groupBy("bucket").cogroup(answers.where("bucket >= 0").groupBy("bucket")).applyInArrow(look_up, sequences),
        "classes",
    )
    weights = new_weights(share / share.sum())
    part_id = F.spark_partition_id()
    for number in range(ROUNDS):
        start = columns(np.zeros(1), *weights)

        def improve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen, node = _unpack(start), 0, None
            for batch in batches:
                node = batch.column(1)[0].as_py() if batch.num_rows else node
                texts = [np.frombuffer(c, np.uint8) for c in batch.column(0).to_pylist()]
                seen += train(own, texts, number)
            if seen:
                yield blob_rows([(node, columns(np.array([float(seen)]), *own))])

        copies = looked_up.where("NOT held_out").select("classes", part_id.alias("node")).mapInArrow(improve, BLOBS)
        merged = tree_merge(copies, _merge_weights)
        if merged is not None:
            weights = _unpack(merged)
    final = columns(np.zeros(1), *weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpack(final)
        for batch in batches:
            texts = [np.frombuffer(c, np.uint8) for c in batch.column(6).to_pylist()]
            total = score(own, texts) + np.asarray(batch.column(5))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.full(len(texts), n_train), pa.int64()), batch.column(4), pa.array(total)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return looked_up.mapInArrow(
        judge, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
