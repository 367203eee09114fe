"""Removal of repeated byte strings by suffixes grouped by hashes.

Every string of ``length`` bytes is a suffix cut at that depth.  Two equal ones
have to meet, so each goes where the smallest hash of the short grams inside it
sends it: neighbouring windows share that gram, so they travel together as one
context, about one context for every 35 bytes.  Contexts whose gram is met
nowhere else cannot repeat and are never sent.

Where contexts meet, suffixes are sorted by bucket-pointer refinement: buckets of
q-grams first, then every bucket is sorted by the buckets that a later offset
points to, and the refined buckets are written back for the next round.  The
earliest member of a last bucket stays, the others are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.arrays import (
    blocks, byte_values, columns, from_columns, ragged, sliding_min, text_buffer, tidy, tidy_group, tidy_pair, window_hashes,
)
from shotweave.llm.groups import BLOBS, blob_rows, fresh, group_count

#: Bytes of the grams that route contexts, at most.
GRAM = 32
#: Bytes of the first buckets.
GRAM_KEY = 4
#: Bytes of text that a group of documents has at least, where there are so many.
LEAST_GROUP = 1 << 19
#: Suffixes sorted at once; contexts of one gram stay together.
SORTED = 1 << 15

_POSITION = np.uint64((1 << 24) - 1)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text row, first window and number of windows of each context, and its gram's hash."""
    gram = min(GRAM, (length + 1) // 2)
    grams = window_hashes(byte_values()[raw], gram)
    if len(raw) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    at = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_POSITION) | at, length - gram + 1) & _POSITION
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= ends
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True)) + 1
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first, stop - first, grams[least[first].astype(np.int64)]


def _within(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``contexts`` of a batch, block by block, in the batch's rows and positions.

    A text longer than the kernels' block is taken in overlapping parts, so that
    their arrays stay small; a context may then be cut in two, which is harmless.
    """
    size = 1 << 20
    for a, b in blocks(offsets, size):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= 4 * size:
            row, first, count, key = contexts(raw[begin:end], offsets[a : b + 1] - begin, length)
            yield row + a, first + begin, count, key
            continue
        # A window in the middle is decided by grams inside it, so parts that
        # overlap by one window less a byte give each window once.
        for part in range(begin, end, size):
            stop = min(part + size + length - 1, end)
            _, first, count, key = contexts(raw[part:stop], np.array([0, stop - part]), length)
            yield np.full(len(first), a), first + part, count, key


def repeats(
    data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int
) -> np.ndarray:
    """Which suffixes of some contexts repeat an earlier one up to ``length``.

    ``data`` has the contexts one after the other in their order of precedence;
    context i offers the ``counts[i]`` suffixes from ``starts[i]`` on.  Returns
    a flag for each suffix.

    ``pointer`` has the bucket of every position: the place of the first of the
    positions that agree as deep as buckets have been refined.  Buckets begin as
    those of q-grams.  A round sorts the members of each bucket by the buckets
    that their later offset points to and writes the refined ones back, where
    the next round reads them; so the depth doubles, and the last round goes on to
    ``length`` with the suffixes alone.
    """
    n, depth = len(data), min(GRAM_KEY, length)
    suffix = ragged(starts, counts)
    padded = np.append(data, np.zeros(depth, np.uint8)).astype(np.int64)
    key = padded[:n]
    for i in range(1, depth):
        key = key << 8 | padded[i : n + i]
    wanted = np.zeros(n, bool)
    wanted[suffix] = True
    key, members = _sorted(key, np.arange(n), n)
    pointer = np.zeros(n + 1, np.int64)  # 0 is behind the end
    size = _sizes(key)
    bucket = np.repeat(np.cumsum(size) - size + 1, size)
    pointer[members] = bucket
    while depth < length:
        step = min(depth, length - depth)
        keep = np.repeat(size > 1, size)
        if depth + step == length:
            keep &= wanted[members]
        members, bucket = members[keep], bucket[keep]
        key, members = _sorted(bucket * (n + 1) + pointer[np.minimum(members + step, n)], members, n)
        # A refined bucket begins as far behind the old one as its members do.
        size = _sizes(key)
        first = np.cumsum(size) - size
        old = key[first] // (n + 1)
        alike = _sizes(old)
        bucket = np.repeat(old + first - np.repeat(first[np.cumsum(alike) - alike], alike), size)
        pointer[members] = bucket
        depth += step
    if length <= GRAM_KEY:
        members, size = members[wanted[members]], _sizes(bucket[wanted[members]])
    # Equal suffixes share a bucket; the one that comes first in the data stays.
    again = np.ones(len(members), bool)
    again[np.cumsum(size) - size] = False
    wanted[:] = False
    wanted[members[again]] = True
    return wanted[suffix]


def _sorted(key: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and with them their positions below ``n``, which settle ties."""
    width = n.bit_length()
    if int(key.max(initial=0)).bit_length() + width > 63:
        order = np.lexsort((at, key))
        return key[order], at[order]
    packed = key << width | at
    packed.sort()
    return packed >> width, packed & ((1 << width) - 1)


def _sizes(key: np.ndarray) -> np.ndarray:
    """How often each of some sorted keys occurs."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.diff(np.flatnonzero(new), append=len(key))


def _by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), [array[order[a:b]] for array in arrays]


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes; all but the hashes in front are compressed, the bytes of a
    number's place together."""
    key, *rest = arrays
    rest = [a if a.itemsize == 1 else a.view(np.uint8).reshape(-1, a.itemsize).T.ravel() for a in map(np.ascontiguousarray, rest)]
    kinds = "".join(a.dtype.char for a in arrays[1:]).encode()
    plain = columns(*rest)
    head = columns(key, np.frombuffer(kinds, np.uint8))
    return len(head).to_bytes(8, "little") + len(plain).to_bytes(8, "little") + head + pa.compress(plain, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    head, plain = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    key, kinds = from_columns(blob[16 : 16 + head])
    rest = from_columns(pa.decompress(blob[16 + head :], plain, "zstd", asbytes=True))
    out = [key]
    for array, kind in zip(rest, kinds.tobytes().decode()):
        kind = np.dtype(kind)
        if kind.itemsize > 1:
            array = np.ascontiguousarray(array.reshape(kind.itemsize, -1).T).view(kind).ravel()
        out.append(array)
    return out


def _joined_columns(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays of all parts one after the other; the parts are given up column by column."""
    joined = []
    for i in range(len(parts[0])):
        joined.append(np.concatenate([part[i] for part in parts]))
        for part in parts:
            part[i] = None
    parts.clear()
    return joined


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(parts) for parts in zip(*map(from_columns, blobs))]


def remove_repeats(
    df: DataFrame, doc_id: str, text: str, length: int = 100, kept: str = "kept", spans: str = "spans"
) -> DataFrame:
    """Cut every ``length``-byte string that starts earlier as well out of the texts.

    Returns the rows and columns of ``df`` with two more: ``kept``, the bytes
    that stay, and ``spans``, the maximal removed runs as (start, length) in
    bytes.  Earlier means a smaller id, or an earlier start in the same text;
    strings never cross texts and are judged on the input.  The earliest
    occurrence always stays.

    Texts are UTF-8 bytes, null is empty, and what is shorter than ``length``
    is left alone.  A null id comes before all others.  Rows with the same id
    are told apart by their text; rows equal in both are one document, and each
    gets its result.  An empty table gives no rows.  Columns of ``df`` with the
    names of the two new ones are replaced, all others pass unchanged.

    Four passes, each over groups of bounded size: grams (one blob per batch and
    bucket), the places of grams met twice, their contexts, and the flags.
    Equal contexts are combined in each group of documents before they are sent,
    so a passage in a third of all documents is one row per group.
    """
    if length < 1:
        raise ValueError("strings have at least one byte")
    df = df.drop(*[c for c in (kept, spans) if c in df.columns and c not in (doc_id, text)])
    own_id, own_copy, own_bucket = fresh(df, "id_of_text", "copy_of_text", "bucket_of_text")
    groups = group_count(df, text, LEAST_GROUP)
    content, names = F.coalesce(df[text], F.lit("")), df.columns
    docs = df.select(
        *[df[c] for c in df.columns],
        F.coalesce(df[doc_id].cast("bigint"), F.lit(-(2**63))).alias(own_id),
        F.hash(content).cast("bigint").alias(own_copy),
        F.pmod(F.xxhash64(df[doc_id]), F.lit(groups)).cast("int").alias(own_bucket),
    )
    brief = docs.select(own_id, own_copy, own_bucket, df[text])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, bucket = (np.asarray(batch.column(i)) for i in range(3))
            raw, offsets = text_buffer(batch.column(3))
            parts = []
            for row, first, count, key in _within(raw, offsets, length):
                parts.append((key, ids[row], copies[row], bucket[row], (first - offsets[row]).astype(np.int32), count.astype(np.uint8 if length < 256 else np.int32)))
            if parts:
                key, *rest = map(np.concatenate, zip(*parts))
                yield blob_rows([(b, _packed(a)) for b, a in _by_bucket(key % np.uint64(groups), key, *rest)])

    def met(table: pa.Table) -> pa.Table:
        key, ids, copies, bucket, first, count = map(np.concatenate, zip(*map(_unpacked, table["blob"].to_pylist())))
        order = np.argsort(key)
        ordered = key[order]
        equal = ordered[1:] == ordered[:-1]
        again = order[np.append(equal, False) | np.append(False, equal)]
        again.sort()
        return pa.Table.from_batches(
            [blob_rows([(b, _packed(a)) for b, a in _by_bucket(bucket[again], key[again], ids[again], copies[again], first[again], count[again])])]
        )

    def send(docs_table: pa.Table, blobs: pa.Table) -> pa.Table:
        if not blobs.num_rows or not docs_table.num_rows:
            return pa.Table.from_batches([blob_rows([])])
        raw, offsets = text_buffer(docs_table[text].combine_chunks())
        key, ids, copies, first, count = map(np.concatenate, zip(*map(_unpacked, blobs["blob"].to_pylist())))
        begin = offsets[:-1][_row_of(docs_table[own_id], docs_table[own_copy], ids, copies)] + first
        order = np.lexsort((first, copies, ids))
        data = raw.tobytes()
        seen: dict[bytes, int] = {}
        leading, following = [], []
        ends = begin + count.astype(np.int64) + (length - 1)
        last = None
        for i, a, b in zip(order.tolist(), begin[order].tolist(), ends[order].tolist()):
            if (a, b) == last:  # an equal row, or a gram noted twice
                continue
            last = (a, b)
            string = data[a:b]
            if seen.setdefault(string, i) == i:
                leading.append(i)
            else:
                following.append(i)
        found = []
        lead = np.array(leading, np.int64)
        own = int(docs_table[own_bucket][0].as_py())
        for b, (members,) in _by_bucket(key[lead] % np.uint64(groups), lead):
            sizes = count[members].astype(np.int64) + (length - 1)
            body = raw[ragged(begin[members], sizes)]
            who = np.full(len(members), own, np.int32)
            found.append((b, b"\0" + _packed([key[members], ids[members], copies[members], who, first[members], count[members], body])))
        if following:
            rest = np.array(following, np.int64)
            spans = columns(ids[rest], copies[rest], first[rest].astype(np.int64), first[rest] + count[rest].astype(np.int64))
            found.append((own, b"\1" + spans))
        return pa.Table.from_batches([blob_rows(found)])

    def judge(table: pa.Table) -> pa.Table:
        own = int(table["bucket"][0].as_py())
        out, sent = [], []
        for blob in table["blob"]:  # one at a time: the list of all would be a copy
            blob = blob.as_py()
            if blob[0] == 1:
                out.append((own, blob[1:]))
            else:
                sent.append(_unpacked(blob[1:]))
        if sent:
            key, ids, copies, bucket, first, count, body = _joined_columns(sent)
            count = count.astype(np.int64)
            sizes = count + (length - 1)
            begin = np.cumsum(sizes) - sizes
            order = np.lexsort((first, copies, ids, key))
            ordered = key[order]
            # Windows of one context have the same gram at different places, so none
            # equals another: what is alone with its gram has no repeats.
            same = ordered[1:] == ordered[:-1]
            met_here = np.append(same, False) | np.append(False, same)
            order, ordered = order[met_here], ordered[met_here]
            last = np.append(ordered[1:] != ordered[:-1], True)
            running = np.cumsum(count[order])
            cut, ends, runs = 0, np.flatnonzero(last) + 1, []
            while cut < len(order):
                base = running[cut - 1] if cut else 0
                i = int(np.searchsorted(running[ends - 1], base + SORTED, "right")) - 1
                i = max(i, int(np.searchsorted(ends, cut, "right")))
                stop = int(ends[min(i, len(ends) - 1)])
                part = order[cut:stop]
                cut = stop
                if len(part) < 2:
                    continue
                data = body[ragged(begin[part], sizes[part])]
                at = np.cumsum(sizes[part]) - sizes[part]
                flags = repeats(data, at, count[part], length)
                runs.append(_runs(flags, part, ids, copies, bucket, first, count))
            if runs:
                out += [(b, columns(*a)) for b, a in _by_bucket(*map(np.concatenate, zip(*runs)))]
        return pa.Table.from_batches([blob_rows(out)])

    def cut_out(docs_table: pa.Table, blobs: pa.Table) -> pa.Table:
        raw, offsets = text_buffer(docs_table[text].combine_chunks())
        cover = np.zeros(len(raw) + 1, np.int32)
        if blobs.num_rows and docs_table.num_rows:
            ids, copies, first, stop = _joined(blobs["blob"].to_pylist())
            for rows in _rows_of(docs_table[own_id], docs_table[own_copy], ids, copies):
                hit = rows >= 0
                begin = offsets[:-1][rows[hit]]
                np.add.at(cover, begin + first[hit], 1)
                np.add.at(cover, begin + stop[hit] + (length - 1), -1)
        return removed_columns(docs_table.select(names), raw, offsets, np.cumsum(cover[:-1]) > 0, (kept, spans))

    noted = brief.mapInArrow(tidy(grams), BLOBS).groupBy("bucket").applyInArrow(tidy_group(met), BLOBS)
    # Both cogroups read one exchange of the texts.
    sent = docs.groupBy(own_bucket).cogroup(noted.groupBy("bucket")).applyInArrow(tidy_pair(send), BLOBS)
    judged = sent.groupBy("bucket").applyInArrow(tidy_group(judge), BLOBS)
    schema = T.StructType([*df.schema.fields, T.StructField(kept, T.BinaryType()), T.StructField(spans, SPANS)])
    return docs.groupBy(own_bucket).cogroup(judged.groupBy("bucket")).applyInArrow(tidy_pair(cut_out), schema)


def removed_columns(
    table: pa.Table, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray, names: tuple[str, str],
    least: int = 1,
) -> pa.Table:
    """Add the kept bytes and the spans of the bytes marked as gone, in runs of ``least`` or more, or a whole text."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start, end = gone.copy(), gone.copy()
    start[1:] &= ~gone[:-1] | edge[1:-1]
    end[:-1] &= ~gone[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    if least > 1:
        owner = np.searchsorted(offsets, start, "right") - 1
        short = end - start < np.minimum(least, np.diff(offsets)[owner])
        gone[ragged(start[short], (end - start)[short])] = False
        start, end = start[~short], end[~short]
    owner = np.searchsorted(offsets, start, "right") - 1
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(start, offsets), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(start - offsets[owner], pa.int64()), pa.array(end - start, pa.int64())], names=["start", "length"]
        ),
    )
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~gone, out=before[1:])
    left, at = raw[~gone].tobytes(), before[offsets].tolist()
    kept = pa.array([left[a:b] for a, b in zip(at, at[1:])], pa.binary())
    return table.append_column(names[0], kept).append_column(names[1], spans)


def _identity(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    both = np.empty(len(ids), [("id", np.int64), ("copy", np.int64)])
    both["id"], both["copy"] = ids, copies
    return both


def _row_of(own_ids, own_copies, ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """A row of each document named."""
    there = _identity(np.asarray(own_ids), np.asarray(own_copies))
    order = np.lexsort((there["copy"], there["id"]))
    wanted, inverse = np.unique(_identity(ids, copies), return_inverse=True)
    return order[np.searchsorted(there[order], wanted)][inverse]


def _rows_of(own_ids, own_copies, ids: np.ndarray, copies: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each document named: first ones, then further equal rows, -1 for none."""
    there = _identity(np.asarray(own_ids), np.asarray(own_copies))
    order = np.lexsort((there["copy"], there["id"]))
    ordered = there[order]
    wanted, inverse = np.unique(_identity(ids, copies), return_inverse=True)
    low, high = np.searchsorted(ordered, wanted), np.searchsorted(ordered, wanted, "right")
    for step in range(int((high - low).max(initial=0))):
        at = low + step
        yield np.where(at < high, order[np.minimum(at, len(order) - 1)], -1)[inverse]


def _runs(flags, part, ids, copies, bucket, first, count) -> tuple[np.ndarray, ...]:
    """Runs of repeated windows: group of documents, id, copy, first, stop."""
    sizes = count[part]
    context = np.repeat(np.arange(len(part)), sizes)
    head = np.zeros(len(flags), bool)
    head[np.cumsum(sizes) - sizes] = True
    start = flags.copy()
    start[1:] &= ~flags[:-1] | head[1:]
    end = flags.copy()
    end[:-1] &= ~flags[1:] | head[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    owner = part[context[start]]
    shift = first[owner] - (np.cumsum(sizes) - sizes)[context[start]]
    return bucket[owner], ids[owner], copies[owner], start + shift, end + 1 + shift
