"""Best-fit packing of documents into sequences of a fixed number of tokens.

Sizes are whole numbers up to the capacity, so a packing depends on the documents only
through how many pieces there are of each size. A Spark job counts that; the plan is made
on those at most `capacity` counts, for all pieces of a size at once; each piece then finds
its place by its rank among the pieces of its size. The plan's size and the time to make it
are bounded by the capacity, whatever the number of documents, and the packing is the global
one: nothing is packed per shard.

The plan: pieces above one third of the capacity are matched greedily, the largest with the
largest that fits, so a sequence holds at most two of them. Smaller ones follow by falling
size, each into the narrowest gap that takes it.

Defined results: a null text is an empty one and has the end token alone. Repeated rows are
documents of their own. Among pieces of one size the order is doc_id, text digest, piece; rows equal in all are
interchangeable. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.encoding import PATTERN, Vocabulary, encoder
from platewise.llm.rawtext import pieces
from platewise.llm.scratch import Sent, stored

CAPACITY = 2048
#: White space in a row from which the pattern of the faster tokenizer may run out of stack.
LONG_BLANK = 100_000
#: Closes every document.
END = 0

PIECES = "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

def tokenizer(ranks: bytes) -> tiktoken.Encoding:
    """A byte-pair tokenizer from `token rank` lines and, after a blank line, special tokens alike."""
    plain, special = ranks.split(b"\n\n")
    read = lambda block: {base64.b64decode(a): int(b) for a, b in map(bytes.split, block.splitlines())}
    names = {token.decode(): i for token, i in read(special).items()}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=read(plain), special_tokens=names)


def ranks_of(vocabulary: str) -> bytes:
    """The ids of a byte-level tokenizer file in the form of `tokenizer`."""
    model = Vocabulary(vocabulary)
    special = set(model.special.values())
    line = lambda i: base64.b64encode(model.tokens[i]) + b" %d" % i
    plain = [line(i) for i, token in enumerate(model.tokens) if token and i not in special]
    return b"\n".join(plain) + b"\n\n" + b"\n".join(map(line, sorted(special)))


def has_long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in re.finditer(r"\s+", text))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with their place in it, length and checksum.

    Only documents over the capacity are cut; their first piece takes what the full ones leave.
    """
    ranks = Sent(docs.sparkSession, ranks_of(vocabulary), tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks.get()
        for part in pieces(batches):
            rows: list[list] = [[], [], [], [], []]
            for k, text in enumerate(part.column("text").fill_null("").to_pylist()):
                # both give the same ids; the slower one takes white space of any length
                own = encoder(vocabulary).encode([text])[0] if has_long_blank(text) else model.encode_to_numpy(text, allowed_special="all")
                ids = np.append(own, np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(rows, (k, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            columns = [part.column("doc_id").take(at), part.column("text_hash").take(at)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns += [pa.array(values, kind) for values, kind in zip(rows[1:], kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "piece", "start", "length", "ids_crc32"])

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, PIECES)


class Plan:
    """Which places the pieces of each size take, in runs of equal steps.

    Run: the pieces of `size` with ranks from `rank` on, `count` of them, go to the sequences
    from `sequence` on, `each` to a sequence, the first of them at `offset`.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._left = {s: n for s, n in counts.items() if n}
        self._rank: dict[int, int] = dict.fromkeys(counts, 0)
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # width: (sequence, how many)
        self._widths: list[int] = []
        large = sorted((s for s in self._left if 3 * s > capacity), reverse=True)
        self._match(large)
        for size in sorted(self._left, reverse=True):
            self._fill(size)
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        self.size, self.rank, self.count, self.sequence, self.each, self.offset = runs.T

    def _take(self, size: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((size, self._rank[size], count, sequence, each, offset))
        self._rank[size] += count
        self._left[size] -= count

    def _gap(self, width: int, sequence: int, count: int) -> None:
        if width and count:
            if not self._gaps.get(width):
                self._gaps[width] = []
                insort(self._widths, width)
            self._gaps[width].append((sequence, count))

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _match(self, large: list[int]) -> None:
        ordered = sorted(large)
        for size in large:
            while self._left[size]:
                at = bisect_left(ordered, self.capacity - size + 1) - 1
                while at >= 0 and (not self._left[ordered[at]] or (ordered[at] == size and self._left[size] < 2)):
                    at -= 1
                if at < 0:
                    count = self._left[size]
                    first = self._open(count)
                    self._take(size, count, first, 1, 0)
                    self._gap(self.capacity - size, first, count)
                    break
                other = ordered[at]
                count = self._left[size] // 2 if other == size else min(self._left[size], self._left[other])
                first = self._open(count)
                if other == size:
                    self._take(size, 2 * count, first, 2, 0)
                else:
                    self._take(size, count, first, 1, 0)
                    self._take(other, count, first, 1, size)
                self._gap(self.capacity - size - other, first, count)

    def _fill(self, size: int) -> None:
        while self._left[size]:
            at = bisect_left(self._widths, size)
            if at == len(self._widths):
                width, sequence, there = self.capacity, -1, -(-self._left[size] // (self.capacity // size))
                sequence = self._open(there)
            else:
                width = self._widths[at]
                sequence, there = self._gaps[width].pop()
                if not self._gaps[width]:
                    self._widths.pop(at)
            each = width // size
            offset = self.capacity - width
            full = min(there, self._left[size] // each)
            if full:
                self._take(size, full * each, sequence, each, offset)
                self._gap(width - each * size, sequence, full)
                sequence, there = sequence + full, there - full
            if there and 0 < self._left[size] < each:
                some = self._left[size]
                self._take(size, some, sequence, some, offset)
                self._gap(width - some * size, sequence, 1)
                sequence, there = sequence + 1, there - 1
            self._gap(width, sequence, there)

    def places(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these ranks among those of their size."""
        shift = np.int64(1) << np.int64(48)
        run = np.searchsorted(self.size * shift + self.rank, sizes * shift + ranks, "right") - 1
        step = ranks - self.rank[run]
        return self.sequence[run] + step // self.each[run], self.offset[run] + step % self.each[run] * sizes


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(token_pieces(docs, vocabulary, capacity), "pieces")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(salts)))
    plan = Plan({r.length: r["count"] for r in cut.groupBy("length").count().collect()}, capacity)
    # a size may hold most rows: its pieces are numbered within salted parts, one after another
    sizes = cut.groupBy("length", "salt").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("length").orderBy("salt")) - F.col("size")
    sizes = sizes.select("length", "salt", before.alias("before"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "text_hash", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(within)).join(sizes, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy()
            sequence, offset = plan.places(column("length"), column("rank") + column("before") - 1)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"), "before"]
    return ranked.select(*columns).mapInArrow(place, SCHEMA)
