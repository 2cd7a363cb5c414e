"""SimHash near-duplicate groups over a Gray-order hierarchical index.

A text's fingerprint has a bit for each bit of XXH64 (seed 42), set where over half of its
three-word shingles, repeats included, set it. Texts of one fingerprint are one class, so
copies are one row from here on.

The distinct fingerprints are sorted by Gray rank: neighbours in that order differ in few bits.
Runs of them make the nodes of a hierarchy. A node holds the bits that all fingerprints under
it share, as a mask and their values; a child shares its parent's bits and more, so differences
between two nodes only add up on the way down, and as soon as they pass the limit the two
groups are pruned as wholes. The search descends the hierarchy in pairs, each node with itself
and the others: the upper levels, whose nodes are sort ranges, sixteens of ranges and so on, by
joins of children with surviving pairs; below, each surviving pair of blocks of some thousand
fingerprints is one row, in which a task goes on through two inner levels down to fingerprints.
With n fingerprints a group meets those within two bits on about log n shared bits, not all.

The links found in a pair of blocks leave it as a forest of the same components (no more edges
than fingerprints); components of all links follow by joins.

Defined results: words keep everything but the case of A-Z; with fewer than three words the
whole sequence is one shingle; a text without words, or null, has fingerprint zero and is linked
like any other. Repeated rows are documents of one class; a component is named by its smallest
doc_id, nulls aside (null where all are). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.graph import components
from platewise.llm.rawtext import LOWER, joined, per_text, pieces, words
from platewise.llm.scratch import stored

# Fixed values of the fingerprint.
WORDS, SEED, BITS = 3, 42, 64
#: Bits in which linked fingerprints may differ.
DISTANCE = 2
#: Fingerprints in a block, in its middle and its lowest nodes; upper nodes under one.
BLOCK, MIDDLE, LEAF, FAN = 4096, 256, 16, 16
#: Fingerprints in a range of the sort, about.
RANGE = 64 * BLOCK
#: Shingles or pairs worked on at once in a task.
AT_ONCE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints


def fingerprint_values(texts: pa.Array) -> np.ndarray:
    """One fingerprint per text."""
    data, starts, ends = joined(texts)
    data = LOWER[data]
    first, last, text = words(data, starts, ends)
    count = per_text(text, len(starts))
    # the words alone, a blank behind each: any run of words is a slice
    size = last - first
    place = np.cumsum(size + 1) - (size + 1)
    line = np.full(int((size + 1).sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(place, size) + within] = data[np.repeat(first, size) + within]
    before = np.cumsum(count) - count
    # a shingle begins at each word that has WORDS - 1 more behind it in its text, or at a short text's first
    shingles = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), shingles)
    head = before[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = np.minimum(head + WORDS, (before + count)[owner]) - 1
    begin, end = place[head], (place + size)[tail]
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    ones = np.zeros((len(count), BITS), np.int64)
    for at in range(0, len(owner), AT_ONCE):
        cut = slice(at, at + AT_ONCE)
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begin[cut].tolist(), end[cut].tolist())], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whose, heads = np.unique(owner[cut], return_index=True)
        ones[whose] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    set_bits = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            values = fingerprint_values(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fingerprint"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fingerprint long")


# --- the index


def gray_rank(value: Column) -> Column:
    """Place of a fingerprint in Gray order, as a long that sorts so."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def shared_bits(groups: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, values) of the bits that the first `counts` entries of each row share."""
    there = np.arange(groups.shape[1]) < counts[:, None]
    ones = np.bitwise_and.reduce(np.where(there, groups, ALL), axis=1)
    zeros = ~np.bitwise_or.reduce(np.where(there, groups, np.uint64(0)), axis=1)
    return ones | zeros, ones


def _runs(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `size` values as rows, the last one filled up; how many are real in each."""
    count = -(-len(values) // size)
    full = np.zeros(count * size, values.dtype)
    full[: len(values)] = values
    sizes = np.full(count, size)
    sizes[-1:] -= count * size - len(values)
    return full.reshape(count, size), sizes


def blocks(classes: DataFrame) -> DataFrame:
    """(place, block, mask, ones, members): the fingerprints in Gray order, cut into blocks.

    `place` is the sort range that a block lies in, a node above it.
    """
    ranges = 1 + classes.count() // RANGE
    order = gray_rank(F.col("fingerprint"))
    ranked = classes.select("fingerprint", order.alias("rank")).repartitionByRange(ranges, "rank").sortWithinPartitions("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, rest = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)

        def cut(values: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            groups, sizes = _runs(values, BLOCK)
            masks, ones = shared_bits(groups, sizes)
            ids = (place << 32) + number + np.arange(len(groups))
            number += len(groups)
            members = [group[:size].tobytes() for group, size in zip(groups, sizes)]
            columns = [pa.array(np.full(len(groups), place)), pa.array(ids), pa.array(masks.view(np.int64)), pa.array(ones.view(np.int64)), pa.array(members, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["place", "block", "mask", "ones", "members"])

        for batch in batches:
            rest = np.concatenate([rest, batch.column(0).to_numpy().view(np.uint64)])
            whole = len(rest) // BLOCK * BLOCK
            if whole:
                yield cut(rest[:whole])
                rest = rest[whole:]
        if len(rest):
            yield cut(rest)

    return stored(ranked.select("fingerprint").mapInArrow(run, "place long, block long, mask long, ones long, members binary"), "blocks")


def _apart(a: str, b: str) -> Column:
    """Differences of two nodes on the bits that each of them shares."""
    differ = F.col(f"{a}.ones").bitwiseXOR(F.col(f"{b}.ones")).bitwiseAND(F.col(f"{a}.mask")).bitwiseAND(F.col(f"{b}.mask"))
    return F.bit_count(differ)


def upper_nodes(below: DataFrame, child: str, parent: Column) -> DataFrame:
    """(node, mask, ones) of the parents."""
    ones = F.bit_and("ones")
    # ones under the mask are ones of all; what is 0 under the mask is 0 in all
    zeros = F.bit_and(F.col("mask").bitwiseAND(F.bitwise_not("ones")))
    return below.groupBy(parent.alias("node")).agg(ones.bitwiseOR(zeros).alias("mask"), ones.alias("ones"))


def block_pairs(index: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(x, y), x <= y: the pairs of blocks that the upper levels do not prune."""
    levels = [index.select(F.col("block").alias("node"), "mask", "ones", F.col("place").alias("parent"))]
    top = index.agg(F.max("place")).first()[0] or 0
    nodes, width = upper_nodes(index, "block", F.col("place")), top + 1
    while width > 1:
        width = -(-width // FAN)
        levels.append(nodes.withColumn("parent", F.floor(F.col("node") / FAN)))
        nodes = upper_nodes(nodes, "node", F.floor(F.col("node") / FAN))
    pairs = nodes.select(F.col("node").alias("x"), F.col("node").alias("y"))
    for level in reversed(levels):
        a, b = level.alias("a"), level.alias("b")
        met = pairs.alias("p").join(a, F.col("p.x") == F.col("a.parent")).join(b, F.col("p.y") == F.col("b.parent"))
        # the children of a node with itself are met once
        near = met.filter((F.col("a.node") <= F.col("b.node")) & (_apart("a", "b") <= distance))
        pairs = near.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    return pairs


class Node:
    """A block with its two inner levels."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.groups, self.sizes = _runs(members, LEAF)
        self.masks, self.ones = shared_bits(self.groups, self.sizes)
        per = MIDDLE // LEAF
        low, counts = _runs(np.arange(len(self.groups)), per)
        there = np.arange(per) < counts[:, None]
        ones = np.bitwise_and.reduce(np.where(there, self.ones[low], ALL), axis=1)
        zeros = np.bitwise_and.reduce(np.where(there, (self.masks & ~self.ones)[low], ALL), axis=1)
        self.low, self.counts = low, counts
        self.upper_masks, self.upper_ones = ones | zeros, ones


def _children(x: np.ndarray, y: np.ndarray, x_low: np.ndarray, x_counts: np.ndarray, y_low: np.ndarray, y_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of the pairs (x, y)."""
    width = x_low.shape[1]
    p, q = np.repeat(np.arange(width), width), np.tile(np.arange(width), width)
    real = (p < x_counts[x][:, None]) & (q < y_counts[y][:, None])
    return x_low[x][:, p][real], y_low[y][:, q][real]


def close_pairs(a: Node, b: Node, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of the fingerprints within the distance, some at a time; of one block each pair once at least."""
    same = a is b
    differ = (a.upper_ones[:, None] ^ b.upper_ones) & a.upper_masks[:, None] & b.upper_masks
    x, y = np.nonzero(np.bitwise_count(differ) <= distance)
    if same:
        x, y = x[x <= y], y[x <= y]
    x, y = _children(x, y, a.low, a.counts, b.low, b.counts)
    near = np.bitwise_count((a.ones[x] ^ b.ones[y]) & a.masks[x] & b.masks[y]) <= distance
    if same:
        near &= x <= y
    x, y = x[near], y[near]
    for at in range(0, len(x), AT_ONCE // 64):
        u, v = x[at : at + AT_ONCE // 64], y[at : at + AT_ONCE // 64]
        close = np.bitwise_count(a.groups[u][:, :, None] ^ b.groups[v][:, None, :]) <= distance
        which, i, j = np.nonzero(close)
        i, j = u[which] * LEAF + i, v[which] * LEAF + j
        real = (i < len(a.members)) & (j < len(b.members))
        if same:
            real &= i < j
        if real.any():
            yield i[real], j[real]


def forest(a: Node, b: Node, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of fingerprints with the same components as all close pairs of two blocks."""
    own = a is b
    label = np.arange(len(a.members) + (0 if own else len(b.members)))
    for i, j in close_pairs(a, b, distance):
        j = j if own else j + len(a.members)
        while True:
            u, v = label[i], label[j]
            if (u == v).all():
                break
            # the larger root hangs below the smaller; then every node finds its root
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while (label != label[label]).any():
                label = label[label]
    values = a.members if own else np.concatenate([a.members, b.members])
    hung = np.flatnonzero(label != np.arange(len(label)))
    return values[hung], values[label[hung]]


def links(index: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (x, y) whose components are those of all fingerprints within the distance."""
    pairs = block_pairs(index, distance)
    own, other = (index.select(F.col("block").alias(c), F.col("members").alias(f"members_{c}")) for c in ("x", "y"))
    both = pairs.join(own, "x").join(other, "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node = None, None
        for batch in batches:
            for x, y, mine, others in zip(*(batch.column(name) for name in ("x", "y", "members_x", "members_y"))):
                if x.as_py() != last:
                    last, node = x.as_py(), Node(np.frombuffer(mine.as_buffer(), np.uint64))
                second = node if x == y else Node(np.frombuffer(others.as_buffer(), np.uint64))
                p, q = forest(node, second, distance)
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], names=["x", "y"])

    return stored(both.select("x", "y", "members_x", "members_y").mapInArrow(run, "x long, y long"), "links")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint and component_id for every row."""
    rows = stored(fingerprints(docs), "fingerprints")
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    edges = links(blocks(classes), distance)
    if edges.isEmpty():
        named = classes.withColumnRenamed("least", "component_id")
    else:
        labels = components(edges)
        known = classes.join(labels.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
        known = stored(known.withColumn("label", F.coalesce("label", "fingerprint")), "labelled")
        least = known.groupBy("label").agg(F.min("least").alias("component_id"))
        named = known.join(least, "label").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
