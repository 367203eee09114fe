"""Near duplicates by chosen paths: trees that branch on minwise tokens.

A document is the set of its five-word shingles.  In each of ``TREES`` trees it
first goes to the node its minwise token names; a node that is still large
branches on two more minwise tokens, again and again.  Two sets of similarity s
take the same branch with probability s, so at 0.75 a pair parts ways in all of
12 trees, however deep, with a probability below one in 500,000, and with two
levels of branching about one in 1,000,000.  With the sketch below, which all
trees share, it is missed with about one in 116,000.

Documents that meet in a small node are compared exhaustively by their sketches.
A large node first compares all its members with a few pivots: where nearly all
are like a pivot, as in a group of near copies, the few others are compared with
all members, and the node is done; otherwise its members differ, and branching
parts them.  What may be similar is put in one candidate group, and groups are
settled on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotweave.llm.arrays import blocks, mix, ragged, text_buffer, tidy, UnionFind, window_hashes
from shotweave.llm.components import components
from shotweave.llm.groups import group_count
from shotweave.llm.language import words
from shotweave.storage import materialise

TREES, COORDINATES = 12, 96
#: Documents compared exhaustively in one node, and levels below the first.
SMALL, DEPTH = 192, 2
PIVOTS = 8
#: Members of a large node that one task compares with those no pivot is like.
PART = 2048
#: Shingles in a candidate group that one task settles, a document counting as
#: ``FEWEST`` at least; a larger group is settled node by node.
SETTLED, FEWEST = 2_000_000, 512

_FACTORS = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; fewer words are one shingle."""
    keys, _, at = words(raw, offsets)
    out, cut = [], at.tolist()
    for a, b in zip(cut, cut[1:]):
        text = keys[a : b - 1]
        out.append(np.unique(window_hashes(text, min(width, len(text)))) if len(text) else text)
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise value of each coordinate."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        part = (low[a : a + 4096][:, None] ^ _OFFSETS) * _FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The minwise values in short, to be compared."""
    return _short(minwise(shingles))


def _short(values: np.ndarray) -> np.ndarray:
    return (mix(values) & np.uint64(0xFFFF)).astype(np.uint16)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a & b| >= percent |a | b|, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _estimates(sketches: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of all pairs, row by row for large nodes."""
    n = len(sketches)
    out = np.zeros((n, n), np.float32)
    for i in range(n - 1):
        out[i, i + 1 :] = (sketches[i + 1 :] == sketches[i]).mean(axis=1)
    return out


def settle(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected, from the full sets.

    A list of the documents of each shingle gives the exact intersections of one
    document with all others at once.
    """
    if len(names) == 2:
        return [(names[0], names[1])] if linked(sets[0], sets[1], percent) else []
    sizes = np.array([len(s) for s in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(shingle, kind="stable")]
    count = np.bincount(shingle)
    begin = np.cumsum(count) - count
    cut = np.append(0, np.cumsum(sizes))
    joined, found = UnionFind(len(names)), []
    for i in range(len(names)):
        own = shingle[cut[i] : cut[i + 1]]
        own = own[count[own] > 1]
        both = np.bincount(owner[ragged(begin[own], count[own])], minlength=len(names))
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both)).tolist():
            if j != i and both[j] and joined.union(i, j):
                found.append((names[i], names[j]))
    return found


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _slices(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist() if len(values) else []
    yield from zip(cuts, [*cuts[1:], len(values)])


def near_groups(df: DataFrame, doc_id: str, text: str, percent: int = 75) -> DataFrame:
    """Components of documents whose shingle sets have ``percent`` of their union in common.

    Returns doc_id, n_shingles, component_id (the lowest id that links reach,
    itself included) and kept (doc_id = component_id), one row per row of
    ``df``.  Words are lower-cased in A-Z only; with fewer than five the whole
    sequence is one shingle; without words, or text, a document is linked with
    nothing.  Every link is confirmed on full sets of 64-bit shingle hashes.

    Equal sets are one set, found by a 128-bit digest that is aggregated before
    the shuffle, so a group of copies of any size is one row per task.  Nodes
    with one member are dropped by a count; large ones are looked at row by row,
    beside a few pivots; and at the last level a node that is still large is one
    candidate group.  Candidate groups of more than ``SETTLED`` shingles are
    settled in the nodes instead, by pairs of blocks where a node is large.
    Pairs are never listed.

    A null id is one document, below all others, and gets a null component.
    Rows that share an id share its component; an empty table gives no rows;
    other columns are not looked at.
    """
    least = (percent - 20) / 100
    groups = group_count(df, text)
    null = F.lit(-(2**63))
    docs = df.select(F.coalesce(df[doc_id].cast("bigint"), null).alias("doc"), df[text].alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                values = [minwise(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([v if v is None else v[:TREES].tobytes() for v in values], pa.binary()),
                        pa.array([v if v is None else _short(v).tobytes() for v in values], pa.binary()),
                    ],
                    names=["doc", "n_shingles", "digest", "roots", "sketch"],
                )

    profile = materialise(
        docs.mapInArrow(tidy(describe), "doc bigint, n_shingles bigint, digest binary, roots binary, sketch binary"), "profile"
    )
    sets = materialise(
        profile.where("n_shingles > 0").groupBy("digest").agg(
            F.min("doc").alias("rep"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "sets",
    )
    sketches = sets.select(F.col("rep").alias("doc"), "sketch")

    def first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TREES)
            node = mix(roots.astype(np.uint64) + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.astype(np.int64).ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), TREES))],
                names=["node", "doc"],
            )

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two children, on coordinates that the node itself chooses."""
        for batch in batches:
            if not batch.num_rows:
                continue
            parents = mix(np.asarray(batch.column(0)).astype(np.uint64)[:, None] + np.array([[1, 2]], np.uint64))
            one = (parents[:, 0] % np.uint64(COORDINATES)).astype(np.int64)
            two = (one + 1 + (parents[:, 1] % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
            taken = np.take_along_axis(_sketches(batch.column(2)), np.stack([one, two], axis=1), axis=1)
            node = mix(parents ^ mix(taken.astype(np.uint64) + np.uint64(1 << 32))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.ravel()), pa.array(np.repeat(np.asarray(batch.column(1)), 2))], names=["node", "doc"]
            )

    def beside_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which pivots of its node each member may be similar to, as bits."""
        for batch in batches:
            own, masks = _sketches(batch.column(2)), np.zeros(batch.num_rows, np.int32)
            for j in range(PIVOTS):
                pivots = batch.column(3 + j)
                there = np.flatnonzero(np.asarray(pivots.is_valid()))
                if len(there):
                    alike = (own[there] == _sketches(pivots.take(pa.array(there)))).mean(axis=1) >= least
                    masks[there[alike]] |= 1 << j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks)], names=["node", "doc", "mask"])

    def beside_others(members: pa.Table, others: pa.Table) -> pa.Table:
        """Members of a node that may be similar to those no pivot is like."""
        if not members.num_rows or not others.num_rows:
            return _pairs([])
        own, values = _sketches(members["sketch"]), _sketches(others["sketch"])
        names = np.concatenate([np.asarray(members["doc"]), np.asarray(others["doc"])]).tolist()
        joined, found = UnionFind(len(names)), []
        for j in range(len(values)):
            for i in np.flatnonzero((own == values[j]).mean(axis=1) >= least).tolist():
                if joined.union(i, len(own) + j):
                    found.append((names[i], names[len(own) + j]))
        return _pairs(found)

    rows = sets.select(F.col("rep").alias("doc"), "roots").mapInArrow(first_nodes, "node bigint, doc bigint")
    pairs = "a bigint, b bigint"
    small, edges, done, large = [], [], [], None
    for level in range(DEPTH + 1):
        rows = materialise(rows, "nodes")
        sizes = materialise(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("doc").alias("low")).where("n > 1"), "sizes")
        # One join: an ordinary one, so that it costs the same at every size.
        met = materialise(rows.join(sizes.hint("merge"), "node"), "met")
        small.append(met.where(F.col("n") <= SMALL).select("node", "doc"))
        large = met.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        shown = materialise(large.select("node", "doc", "n").join(sketches.hint("merge"), "doc").select("node", "doc", "sketch", "n"), "shown")
        chance = F.xxhash64("node", "doc")
        drawn = F.struct(chance.alias("chance"), "doc", "sketch")
        pivots = materialise(
            shown.groupBy("node").agg(*[
                F.min(F.when(F.pmod(chance, F.lit(PIVOTS)) == j, drawn)).alias(f"p{j}") for j in range(PIVOTS)
            ]).select(
                "node", *[F.col(f"p{j}.doc").alias(f"d{j}") for j in range(PIVOTS)],
                *[F.col(f"p{j}.sketch").alias(f"s{j}") for j in range(PIVOTS)],
            ),
            "pivots",
        )
        beside = shown.join(pivots, "node")
        masks = materialise(
            beside.select("node", "doc", "sketch", *[f"s{j}" for j in range(PIVOTS)]).mapInArrow(
                beside_pivots, "node bigint, doc bigint, mask int"
            ),
            "masks",
        )
        named = pivots.select("node", F.array(*[f"d{j}" for j in range(PIVOTS)]).alias("pivot"))
        # At most 2^PIVOTS different masks a node: they tell which pivots are connected.
        judged = materialise(
            masks.groupBy("node").agg(F.count_if(F.col("mask") == 0).alias("others"), F.collect_set("mask").alias("seen"))
            .withColumn("joined", _connected(F.col("seen"))).join(named, "node"),
            "judged",
        )
        first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda j: F.getbit("mask", j).cast("int")), 1)
        edges.append(
            masks.where("mask > 0").join(named, "node").select(F.element_at("pivot", first.cast("int")).alias("a"), F.col("doc").alias("b"))
        )
        bits = F.explode(F.transform("seen", lambda m: F.filter(F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda j: F.when(F.getbit(m, j) == 1, j)), lambda j: j.isNotNull())))
        edges.append(
            judged.select("pivot", bits.alias("bits")).where(F.size("bits") > 1)
            .select("pivot", F.col("bits")[0].alias("one"), F.explode("bits").alias("two")).where("one != two")
            .select(F.element_at("pivot", F.col("one") + 1).alias("a"), F.element_at("pivot", F.col("two") + 1).alias("b"))
        )
        finished = judged.where((F.col("others") <= SMALL) & F.col("joined")).select("node", "others")
        # A part of a node's members meets all the others of that node.
        parts = F.ceil(F.col("n") / PART)
        asked = materialise(
            masks.where("mask = 0").join(finished, "node").join(shown, ["node", "doc"]).select("node", "doc", "sketch", "n"), "others"
        )
        everyone = asked.select("node", "doc", "sketch", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
        members = shown.join(asked.select("node").distinct(), "node", "left_semi").select(
            "node", "doc", "sketch", F.pmod(F.xxhash64("doc"), parts).alias("part")
        )
        edges.append(
            members.groupBy("node", "part").cogroup(everyone.groupBy("node", "part")).applyInArrow(beside_others, pairs)
        )
        done.append(large.join(finished, "node", "left_semi"))
        large = large.join(finished, "node", "left_anti")
        if level < DEPTH:
            rows = shown.join(finished, "node", "left_anti").select("node", "doc", "sketch").mapInArrow(branch, "node bigint, doc bigint")
    leaves = small[0]
    for part in small[1:]:
        leaves = leaves.unionByName(part)

    def compare(table: pa.Table) -> pa.Table:
        node, doc = table["node"].to_numpy(), table["doc"].to_numpy()
        order = np.lexsort((doc, node))
        node, doc = node[order], doc[order]
        values = _sketches(table["sketch"])[order]
        found = []
        for a, b in _slices(node):
            joined = UnionFind(b - a)
            left, right = np.nonzero(_estimates(values[a:b]) >= least)
            for i, j in zip(left.tolist(), right.tolist()):
                if joined.union(i, j):
                    found.append((int(doc[a + i]), int(doc[a + j])))
        return _pairs(found)

    deal = F.pmod(F.col("node"), F.lit(groups))
    candidates = (
        leaves.join(sketches.hint("merge"), "doc").withColumn("deal", deal)
        .groupBy("deal").applyInArrow(compare, pairs)
        .unionByName(large.select(F.col("low").alias("a"), F.col("doc").alias("b")))
    )
    for part in edges:
        candidates = candidates.unionByName(part)
    grouped = components(candidates)
    # A root is a member as well.
    member = materialise(
        grouped.select(F.col("node").alias("doc"), F.col("root").alias("group"))
        .unionByName(grouped.select(F.col("root").alias("doc"), F.col("root").alias("group")).distinct()),
        "members",
    )
    weight = (
        member.join(sets.select(F.col("rep").alias("doc"), "n_shingles"), "doc")
        .groupBy("group").agg(F.sum(F.greatest("n_shingles", F.lit(FEWEST))).alias("shingles"))
    )
    sized = materialise(member.join(materialise(weight, "weights"), "group"), "sized")
    units = sized.where(F.col("shingles") <= SETTLED).select(F.col("group").alias("unit"), "doc")
    heavy = sized.where(F.col("shingles") > SETTLED).select("doc")
    in_nodes = leaves.join(heavy, "doc", "left_semi").select(F.xxhash64("node").alias("unit"), "doc")
    units = units.unionByName(in_nodes)
    for part in [large, *done]:
        units = units.unionByName(_block_pairs(part.join(heavy, "doc", "left_semi")))

    def settled(table: pa.Table) -> pa.Table:
        unit, doc = table["unit"].to_numpy(), table["doc"].to_numpy()
        order = np.lexsort((doc, unit))
        raw, offsets = text_buffer(table["text"].take(pa.array(order)).combine_chunks())
        found = []
        for a, b in _slices(unit[order]):
            names = doc[order[a:b]].tolist()
            found += settle(names, shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), percent)
        return _pairs([(a, b) for a, b in found if a != b])

    placed = docs.join(materialise(units.distinct(), "units").hint("merge"), "doc")
    links = placed.withColumn("deal", F.pmod(F.xxhash64("unit"), F.lit(groups))).groupBy("deal").applyInArrow(
        settled, pairs
    )
    roots = components(links)
    classes = materialise(
        sets.select("digest", "rep").join(roots, sets["rep"] == roots["node"], "left")
        .select("digest", F.coalesce("root", "rep").alias("component_id")),
        "classes",
    )
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc")).otherwise(F.col("component_id"))
    return (
        profile.select("doc", "n_shingles", "digest").join(classes, "digest", "left")
        .select(
            F.nullif("doc", null).alias("doc_id"), "n_shingles", F.nullif(component, null).alias("component_id"),
            (F.col("doc") == component).alias("kept"),
        )
    )


@F.udf(T.BooleanType())
def _connected(seen):
    """Whether shared members connect all pivots that have any."""
    reached, rest = 0, [m for m in seen if m]
    if rest:
        reached = rest.pop()
    while joined := [m for m in rest if m & reached]:
        for m in joined:
            reached |= m
        rest = [m for m in rest if not m & reached]
    return not rest


def _block_pairs(large: DataFrame) -> DataFrame:
    """Units that hold two blocks each of a large node, so that all its pairs meet."""
    count = F.ceil(F.col("n") / SMALL)
    block = F.pmod(F.xxhash64("doc", "node"), count)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    return (
        large.withColumn("block", block).withColumn("other", other)
        .select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "doc")
    )
