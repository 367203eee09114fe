"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.arrays import blocks, columns, from_columns, mix, ragged, text_buffer
from shotweave.llm.groups import BLOBS, blob_rows, fresh, group_count
from shotweave.llm.suffix import SPANS, _by_bucket, _joined, _rows_of, removed_columns

#: Shortest and longest chunk in bytes, and bits that are zero at its end.
SHORTEST, LONGEST, BITS = 16, 128, 5
#: Repeated chunks go only in runs of so many bytes, or with their whole text; below that text
#: repeats by chance.
LEAST_RUN = 80

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MASK = np.uint32(((1 << BITS) - 1) << (32 - BITS))


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: h = 2 h + gear, which 32 bytes decide."""
    hashes, size = _GEAR[raw], 1
    while size < 32:
        wider = hashes.copy()
        wider[size:] += hashes[:-size] << np.uint32(size)
        hashes, size = wider, size * 2
    return hashes


def chunk_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, and the text of each.

    A chunk ends after a byte whose hash has ``BITS`` zeros, not before
    ``SHORTEST`` bytes and at the latest after ``LONGEST``.  The hash of the
    first bytes of a text sees the end of the text before, so these bytes, which
    lie below the shortest chunk and its window, are hashed again alone.
    """
    hashes = gear_hashes(raw)
    short = 31
    head = ragged(offsets[:-1], np.minimum(np.diff(offsets), short))
    if len(head):
        sizes = np.minimum(np.diff(offsets), short)
        # A text's first bytes behind 32 zero-gear places: one row for each text.
        rows = np.repeat(np.arange(len(sizes)), sizes)
        col = head - np.repeat(offsets[:-1], sizes)
        grid = np.zeros((len(sizes), short), np.uint32)
        grid[rows, col] = _GEAR[raw[head]]
        for c in range(1, short):
            grid[:, c] += grid[:, c - 1] << np.uint32(1)
        hashes[head] = grid[rows, col]
    cuts = np.flatnonzero((hashes & _MASK) == 0) + 1
    ends: list[int] = []
    owner: list[int] = []
    bound = np.searchsorted(cuts, offsets, "right")
    all_cuts = cuts.tolist()
    for text, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        before = len(ends)
        for cut in all_cuts[bound[text] : bound[text + 1]]:
            while cut - begin > LONGEST:
                begin += LONGEST
                ends.append(begin)
            if cut - begin >= SHORTEST and cut < end:
                ends.append(cut)
                begin = cut
        while end - begin > LONGEST:
            begin += LONGEST
            ends.append(begin)
        if end > begin:
            ends.append(end)
        owner += [text] * (len(ends) - before)
    return np.array(ends, np.int64), np.array(owner, np.int64)


def looked_up(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every stretch that is compared.

    Those are the chunks, but a short one at a text's end only together with the
    chunk before it, or alone where it is the whole text.
    """
    ends, row = chunk_ends(raw, offsets)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    first, short = starts == offsets[row], ends - starts < SHORTEST
    tail = np.flatnonzero(short & ~first)
    keep = ~short | first
    return (
        np.concatenate([starts[keep], starts[tail - 1]]),
        np.concatenate([ends[keep], ends[tail]]),
        np.concatenate([row[keep], row[tail]]),
    )


def remove_chunks(
    df: DataFrame, doc_id: str, text: str, kept: str = "kept", spans: str = "spans", least_run: int = LEAST_RUN
) -> DataFrame:
    """Cut chunks that an earlier text, or the same one, has had already.

    Returns the rows and columns of ``df`` with ``kept``, the bytes that stay,
    and ``spans``, the removed runs as (start, length) in bytes.  A chunk is a
    repeat if a chunk with the same 128-bit digest starts earlier, by id and
    then by place; a text's end of less than ``SHORTEST`` bytes is one with the
    chunk before it.  Runs of repeats of ``least_run`` bytes or more go, and
    texts, however short, that consist of repeats only.

    Digests are dealt out in blobs by hash.  A batch sends the earliest chunk of
    each digest only and settles the others itself, so a chunk that a third of
    all texts has is one entry per batch.  Texts are shuffled once, at the end.

    Null text is empty; a null id comes first; rows of the same id are told
    apart by their text, equal ones get the same result; an empty table gives no
    rows.  Columns of ``df`` with the names of the two new ones are replaced.
    """
    df = df.drop(*[c for c in (kept, spans) if c in df.columns and c not in (doc_id, text)])
    own_id, own_copy, own_bucket = fresh(df, "id_of_text", "copy_of_text", "bucket_of_text")
    groups, names = group_count(df, text), df.columns
    content = F.coalesce(df[text], F.lit(""))
    docs = df.select(
        *[df[c] for c in names],
        F.coalesce(df[doc_id].cast("bigint"), F.lit(-(2**63))).alias(own_id),
        F.hash(content).cast("bigint").alias(own_copy),
        F.pmod(F.xxhash64(df[doc_id]), F.lit(groups)).cast("int").alias(own_bucket),
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, own = (np.asarray(batch.column(i)) for i in range(3))
            raw, offsets = text_buffer(batch.column(3))
            parts = []
            for a, b in blocks(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, row = looked_up(part, at)
                data = memoryview(part.tobytes())
                digest = b"".join(
                    [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist())]
                )
                pair = np.frombuffer(digest, np.uint64).reshape(-1, 2)
                begin, row = starts - at[row], row + a
                parts.append((pair[:, 0], pair[:, 1], ids[row], copies[row], own[row], begin, ends - starts))
            if not parts:
                continue
            low, high, name, copy, bucket, begin, size = map(np.concatenate, zip(*parts))
            order = np.lexsort((begin, copy, name, high, low))
            new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))[: len(order)]
            first, rest = np.sort(order[new]), order[~new]
            # An equal row's chunk is the same chunk.
            lead = order[new][np.cumsum(new) - 1][~new]
            twin = (name[rest] == name[lead]) & (copy[rest] == copy[lead]) & (begin[rest] == begin[lead])
            rest = rest[~twin]
            found = [
                (b, b"\0" + columns(*a))
                for b, a in _by_bucket(low[first] % np.uint64(groups), *[x[first] for x in (low, high, name, copy, bucket, begin, size)])
            ]
            found += [(b, b"\1" + columns(*a)) for b, a in _by_bucket(bucket[rest], *[x[rest] for x in (name, copy, begin, size)])]
            yield blob_rows(found)

    def judge(table: pa.Table) -> pa.Table:
        own, out, sent = table["bucket"][0].as_py(), [], []
        for blob in table["blob"].to_pylist():
            if blob[0]:
                out.append((own, blob[1:]))
            else:
                sent.append(blob[1:])
        if sent:
            low, high, name, copy, bucket, begin, size = _joined(sent)
            order = np.lexsort((begin, copy, name, high, low))
            new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
            rest, lead = order[~new], order[new][np.cumsum(new) - 1][~new]
            twin = (name[rest] == name[lead]) & (copy[rest] == copy[lead]) & (begin[rest] == begin[lead])
            rest = rest[~twin]
            out += [(b, columns(*a)) for b, a in _by_bucket(bucket[rest], *[x[rest] for x in (name, copy, begin, size)])]
        return pa.Table.from_batches([blob_rows(out)])

    def cut_out(docs_table: pa.Table, blobs: pa.Table) -> pa.Table:
        raw, offsets = text_buffer(docs_table[text].combine_chunks())
        cover = np.zeros(len(raw) + 1, np.int32)
        if blobs.num_rows and docs_table.num_rows:
            name, copy, begin, size = _joined(blobs["blob"].to_pylist())
            for rows in _rows_of(docs_table[own_id], docs_table[own_copy], name, copy):
                hit = rows >= 0
                at = offsets[:-1][rows[hit]] + begin[hit]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size[hit], -1)
        gone = np.cumsum(cover[:-1]) > 0
        return removed_columns(docs_table.select(names), raw, offsets, gone, (kept, spans), least_run)

    brief = docs.select(own_id, own_copy, own_bucket, df[text])
    judged = brief.mapInArrow(send, BLOBS).groupBy("bucket").applyInArrow(judge, BLOBS)
    schema = T.StructType([*df.schema.fields, T.StructField(kept, T.BinaryType()), T.StructField(spans, SPANS)])
    return docs.groupBy(own_bucket).cogroup(judged.groupBy("bucket")).applyInArrow(cut_out, schema)
