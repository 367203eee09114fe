"""Packing token sequences: best fit within partitions, then up a tree of them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shotweave.llm.arrays import blocks, text_buffer, tidy
from shotweave.llm.pieces import PieceEncoder
from shotweave.storage import fits_broadcast, materialise

#: Pieces that one node of the tree packs at once.
NODE = 1 << 17
#: Nodes that meet in a node above.
FAN = 8
#: A sequence with fewer free tokens than one in so many is nearly full.
NEARLY = 64
#: Pieces that the tokenizer gets at once, and bytes of text that are cut into pieces at once.
PIECES_AT_ONCE = 1 << 12
SMALL_BLOCK = 1 << 18
#: Bits of the number of a sequence in its partition: sequences are numbered by level, node and place.
ROOM = 36

_PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
    + [T.StructField(n, T.LongType()) for n in ("bin", "offset", "fill", "rank")]
)
#: Sequences number ``first`` to ``last`` - 1 of a node's with ``fill`` tokens go, in this order, into
#: the sequences from ``to_first`` of those with ``to_fill`` tokens in the node above, ``shift`` tokens
#: in; ``bin`` is the first one's number, and ``open`` tells that they go further up.
_MOVES = "node bigint, fill bigint, first bigint, last bigint, up bigint, to_fill bigint, to_first bigint, shift bigint, bin bigint, open boolean"


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: bin and offset of each item, and each bin's fill."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    free: dict[int, list[int]] = {}
    mask = 0  # bit r is set where a bin has r tokens free
    for item in order:
        length = lengths[item]
        fitting = mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            stack = free[room]
            chosen = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += length
        room -= length
        if room:
            free.setdefault(room, []).append(chosen)
            mask |= 1 << room
    return bins, offsets, fills


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, of ``counts[length]`` items of each length.

    Bins that are filled alike are one entry: how many, and for each place in them
    the length and the number of the first bin's item among those of its length;
    the next bin has the next item.  So there are few entries however many items.
    """
    done: list[tuple[int, list[tuple[int, int]]]] = []
    free: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    mask = 0  # bit r is set where a group of bins has r tokens free

    def put(room: int, many: int, places: list[tuple[int, int]]) -> None:
        nonlocal mask
        if many and room:
            free.setdefault(room, []).append((many, places))
            mask |= 1 << room
        elif many:
            done.append((many, places))

    for length in sorted(counts, reverse=True):
        left, item = counts[length], 0
        while left:
            fitting = mask >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                many, places = free[room].pop()
                if not free[room]:
                    mask ^= 1 << room
            else:
                room, many, places = capacity, left, []
            # The bin that has just got an item is the tightest one for the next of its length.
            each = room // length
            for some, more in ((min(many, left // each), each), (1, left % each)):
                if some and more and many and left >= some * more:
                    put(room - more * length, some, places + [(length, item + j * some) for j in range(more)])
                    item, left, many = item + some * more, left - some * more, many - some
                    places = [(size, first + some) for size, first in places]
            if places:
                put(room, many, places)
    return done + [group for room in free.values() for group in room]


@lru_cache(maxsize=1)
def _encoder(key: str, shared) -> PieceEncoder:
    tokenizer = Tokenizer.from_str(shared.value)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = []
        for a in range(0, len(pieces), PIECES_AT_ONCE):
            some = [p.decode() for p in pieces[a : a + PIECES_AT_ONCE]]
            ids += [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for part in ids for i in part), np.uint32, int(counts.sum())), counts

    return PieceEncoder(encode)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pack(
    df: DataFrame, doc_id: str, text: str, capacity: int = 1024, end_id: int = 2, path: str | None = None
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its token ids and ``end_id``; null counts as empty, so every
    row has at least that one.  Only longer ones are cut.  Columns per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A partition packs its pieces by best fit and is done with nearly full
    sequences.  The others go up a tree, ``FAN`` nodes into one, as items that
    best fit puts together again, until one node is left.  A node sees how many
    of them have each fill, at most ``capacity`` numbers from each node below,
    and moves ranges of equal ones.  The moves of all levels are put together
    and pieces follow them in one join.  Repeated rows are packed as often as they come; an empty table
    gives no rows; other columns are not looked at.
    """
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = file.read()
    spark = df.sparkSession
    shared, key = spark.sparkContext.broadcast(model), hashlib.sha256(model.encode()).hexdigest()
    rows = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text"))
    most = capacity - capacity // NEARLY

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = _encoder(key, shared)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in blocks(offsets, SMALL_BLOCK):
                ids, at = encoder(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = at.tolist()
                for row in range(b - a):
                    tokens = ids[at[row] : at[row + 1]].astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                    for number, (start, length) in enumerate(_cut(len(tokens) // 4, capacity)):
                        crc = zlib.crc32(tokens[4 * start : 4 * (start + length)])
                        yield names[a + row], number, start, length, crc

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << ROOM
        held: list[tuple] = []
        seen = [0] * (capacity + 1)

        def packed() -> pa.RecordBatch:
            nonlocal number, held
            bins, offsets, fills = best_fit([piece[3] for piece in held], capacity)
            ranks = []
            for fill in fills:
                ranks.append(seen[fill])
                seen[fill] += 1
            columns = [*map(list, zip(*held)), [number + b for b in bins], offsets]
            columns += [[fills[b] for b in bins], [ranks[b] for b in bins]]
            number, held = number + len(fills), []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=_PIECES.names
            )

        for piece in tokenise(batches):
            held.append(piece)
            if len(held) == NODE:
                yield packed()
        if held:
            yield packed()

    pieces = materialise(rows.mapInArrow(tidy(leaf), _PIECES), "pieces")
    node = F.shiftright("bin", ROOM)
    fills = pieces.where(F.col("fill") <= most).groupBy(node.alias("node"), "fill").agg((F.max("rank") + 1).alias("many"))
    nodes, level, moves = (pieces.agg(F.max(node)).first()[0] or 0) + 1, 0, None
    while nodes > 1:
        nodes, level = -(-nodes // FAN), level + 1
        steps = materialise(
            fills.withColumn("up", F.floor(F.col("node") / FAN)).groupBy("up")
            .applyInArrow(_merge(level, capacity, most), _MOVES),
            "moves",
        )
        moves = steps if moves is None else materialise(_followed(moves, steps), "moves")
        # A place at the start of a sequence stands for the sequence.
        fills = (
            steps.where("open AND shift = 0").groupBy(F.col("up").alias("node"), F.col("to_fill").alias("fill"))
            .agg(F.sum(F.expr("last - first")).alias("many"))
        )
    columns = ("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32")
    if moves is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    moves = moves.select(
        F.col("node").alias("from_node"), F.col("fill").alias("from_fill"), "first", "last", "shift", F.col("bin").alias("to_bin")
    )
    moves = F.broadcast(moves) if fits_broadcast(moves) else moves
    here = (node == F.col("from_node")) & (F.col("fill") == F.col("from_fill"))
    here &= (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return pieces.join(moves, here, "left").select(
        *columns,
        F.coalesce(F.col("to_bin") + F.col("rank") - F.col("first"), "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _merge(level: int, capacity: int, most: int):
    """Best fit of the open sequences of the nodes below one, as moves of them."""
    span, base = FAN**level << ROOM, level << 58

    def merge(table: pa.Table) -> pa.Table:
        up = table["up"][0].as_py()
        below: dict[int, list[tuple[int, int, int]]] = {}
        for node, fill, many in sorted(zip(*(table[c].to_pylist() for c in ("node", "fill", "many")))):
            parts = below.setdefault(fill, [])
            first = parts[-1][2] if parts else 0
            parts.append((node, first, first + many))
        groups = best_fit_counts({fill: parts[-1][2] for fill, parts in below.items()}, capacity)
        number, ranks, out = base + up * span, [0] * (capacity + 1), []
        for many, places in groups:
            total, shift = sum(fill for fill, _ in places), 0
            for fill, item in places:
                for node, first, last in below[fill]:
                    a, b = max(item, first), min(item + many, last)
                    if a < b:
                        at = a - item
                        out.append((node, fill, a - first, b - first, up, total, ranks[total] + at, shift, number + at, total <= most))
                shift += fill
            ranks[total] += many
            number += many
        types = [pa.int64()] * 9 + [pa.bool_()]
        names = [c.split()[0] for c in _MOVES.split(", ")]
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, zip(*out), types, strict=True)})

    return merge


def _followed(moves: DataFrame, steps: DataFrame) -> DataFrame:
    """Moves up to a level and the steps from there as one: ranges are cut where either is."""
    at, to = moves.where("open").alias("at"), steps.alias("to")
    meet = F.expr(
        "at.up = to.node AND at.to_fill = to.fill AND at.to_first < to.last "
        "AND to.first < at.to_first + at.last - at.first"
    )
    both = at.join(to, meet).withColumn("cut", F.expr("greatest(to.first, at.to_first)")).withColumn(
        "end", F.expr("least(to.last, at.to_first + at.last - at.first)")
    )
    further = both.selectExpr(
        "at.node", "at.fill", "at.first + cut - at.to_first AS first", "at.first + end - at.to_first AS last",
        "to.up", "to.to_fill", "to.to_first + cut - to.first AS to_first", "at.shift + to.shift AS shift",
        "to.bin + cut - to.first AS bin", "to.open",
    )
    return moves.where("NOT open").unionByName(further)
