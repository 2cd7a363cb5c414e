"""Exact top-k search by no-random-access aggregation.

Vectors become whole numbers, floor(256 * x). Candidates are packed into blocks of bounded
size, each with one sorted list per component; queries are packed into blocks too. Groups of
query blocks and shares of the candidate blocks span a grid, and each cell of it is a partition:
its task holds the queries and takes the candidate blocks one after the other. In a block, a
query reads the lists in order, from the end that its component's sign favours. Each read tells
one component of one candidate; what is still unread of a candidate lies between the list's far
end and the place reached, which bounds its score from both sides. Reading stops once the
candidates never met cannot reach the bar: the k-th best score of the blocks before, in the first
block the k-th best lower bound. Those met that still can reach it have their scores resolved in
full. A cell keeps k rows per query, which are then ranked. Nothing is joined or sent through
the driver: each row goes to its cells by one shuffle.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part. Shorter vectors count as if zeros followed. Repeated rows are candidates of their own;
a query's own id is none of its candidates, and of query rows with one id the smallest vector
asks. Equal scores go to the smaller vec_id. A null vec_id is neither query nor candidate. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.scratch import stored

K = 5
#: Rows of a candidate block and of a query block, on average, of vectors up to so wide; of wider ones fewer.
CANDIDATES = 8192
QUERIES = 512
WIDTH = 64
#: Query blocks that a task holds, at most about.
HELD = 128
#: How far the lists are read before each look at the bounds, of the last of these.
DEPTHS = (2, 4, 8, 12, 16)
#: Reading goes on while more than this part of a block's candidates can reach the bar.
FEW = 64
#: Of the first block of a task, one row of so many comes first, so that the others meet a bar.
FIRST = 16

SCHEMA = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * 256)).alias("vector"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    return out


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(block, ids, vectors, width), and how many blocks; their sizes follow a hash of the id and row."""
    # the row's own place counts besides the id, so that many rows of one id spread too
    kept = stored(rows.withColumns({"place": F.monotonically_increasing_id(), "width": F.size("vector")}), name)
    total, width = kept.agg(F.count("*"), F.max("width")).first()
    count = 1 + total // max(1, size * WIDTH // max(WIDTH, width or 0))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(frame["vector"])
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max)
        return pd.DataFrame({"block": [key[0]], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [matrix.astype(kind).tobytes()], "width": [matrix.shape[1]]})

    block = F.pmod(F.xxhash64("vec_id", "place"), F.lit(count))
    return kept.select("vec_id", "vector", block.alias("block")).groupBy("block").applyInPandas(pack, "block long, ids binary, vectors binary, width int"), count


def _unpacked(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a block, these in the narrowest type that held them."""
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, f"i{len(vectors) // (len(ids) * width)}").reshape(len(ids), width)


class SortedLists:
    """A candidate block with its components in sorted lists, one from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, room: dict[type, np.ndarray] | None = None):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, order, axis=0)
        # each row's place in every list: first those from the highest value down, then those from the lowest up
        place = np.empty(order.shape, np.int32)
        np.put_along_axis(place, order, np.arange(len(order), dtype=np.int32)[:, None], axis=0)
        self.place = np.concatenate([len(order) - 1 - place, place], axis=1)
        self.largest = np.abs(self.sorted.astype(np.float64)).max(initial=0)
        self.told: dict[tuple, np.ndarray] = {}
        self.room = {} if room is None else room
        self.depths: dict[int, int] = {}

    def _reached(self, depth: int, kind: type) -> np.ndarray:
        """The values at which lists read so far have arrived, those read upwards negated."""
        down, up = self.sorted[[len(self.ids) - depth, depth - 1]].astype(kind)
        return np.concatenate([down, -up])

    def _told(self, depth: int, kind: type, least: bool) -> np.ndarray:
        """The least (or most) that each component can be after `depth` reads of every list."""
        if (depth, kind, least) not in self.told:
            values = self.vectors.astype(kind)
            unread = self._reached(len(self.ids) if least else depth, kind)
            self.told[depth, kind, least] = np.where(self.place < depth, np.concatenate([values, -values], axis=1), unread)
        return self.told[depth, kind, least]

    def _bounds(self, weights: np.ndarray, depth: int, least: bool) -> np.ndarray:
        """Bounds of all scores, a row per query; the next call overwrites them."""
        kind, shape = weights.dtype.type, (len(weights), len(self.ids))
        if self.room.get(kind, self.ids[:0]).size < shape[0] * shape[1]:
            self.room[kind] = np.empty(shape[0] * shape[1], kind)
        return np.matmul(weights, self._told(depth, kind, least).T, out=self.room[kind][: shape[0] * shape[1]].reshape(shape))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None, looks: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best candidates of each query; fewer if there are fewer.

        The queries read all lists in step, each from the end that its component's sign
        favours, and leave when their candidates are settled: none unmet can reach the bar, and
        few of those met. Candidates below the `known` score of a query may be missing. `looks`
        has the first of DEPTHS at which a query looks at the bounds, and gets the last one
        where a score was known. Products of whole numbers and their sums are exact here, in
        single precision where they are small; beyond 53 bits the bar is lowered by more than
        they are rounded.
        """
        size = len(self.ids)
        found = [(self.ids[:0], self.ids[:0])] * len(query_ids)
        bars = np.full(len(query_ids), -np.inf) if known is None else known
        looks = np.zeros(len(query_ids), np.int64) if looks is None else looks
        own = np.isin(query_ids, self.ids)
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).astype(np.float64)
        largest = weights.sum(axis=1) * self.largest
        slack = np.where(largest < 1 << 53, 0, largest / (1 << 40))
        if largest.max(initial=0) < 1 << 24:
            weights = weights.astype(np.float32)
        kind = weights.dtype.type
        reading = np.ones(len(query_ids), bool)
        for look, part in enumerate(DEPTHS):
            rest = np.flatnonzero(reading & (looks <= look))
            if not len(rest):
                continue
            depth = max(1, -(-size * part // DEPTHS[-1]))
            bar, new = bars[rest], np.flatnonzero(np.isneginf(bars[rest]))
            if len(new) and size >= k:
                lower = self._bounds(weights[rest[new]], depth, least=True)
                for row in np.flatnonzero(own[rest[new]]):
                    lower[row, self.ids == query_ids[rest[new[row]]]] = -np.inf
                bar[new] = np.partition(lower, size - k, axis=1)[:, size - k]
            bar -= slack[rest]
            closed = (weights[rest] @ self._reached(depth, kind) < bar) | (depth == size)
            rest, bar = rest[closed], bar[closed]
            if not len(rest):
                continue
            can = self._bounds(weights[rest], depth, least=False) >= bar.astype(kind)[:, None]
            many = np.count_nonzero(can, axis=1)
            settled = (many <= max(k, size // FEW)) | (depth == size)
            reading[rest[settled]] = False
            looks[rest[settled & np.isfinite(bars[rest])]] = look
            for query in query_ids[rest[settled]]:
                self.depths[int(query)] = depth
            for row in np.flatnonzero(settled & (many > 0)):
                query, who = rest[row], np.flatnonzero(can[row])
                who = who[self.ids[who] != query_ids[query]]
                scores = self.vectors[who] @ queries[query]
                first = np.lexsort((self.ids[who], -scores))[:k]
                found[query] = self.ids[who[first]], scores[first]
        return found


class Asked:
    """A block of queries with the k best candidates that they have met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found = [(ids[:0], ids[:0])] * len(ids)
        self.bars, self.looks = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)

    def meet(self, lists: SortedLists) -> None:
        width = lists.vectors.shape[1]
        fit = np.zeros((len(self.ids), width), np.int64)
        fit[:, : min(width, self.vectors.shape[1])] = self.vectors[:, :width]
        for i, (ids, scores) in enumerate(lists.best(self.ids, fit, self.k, self.bars, self.looks)):
            if len(ids):
                ids, scores = (np.concatenate(x) for x in zip(self.found[i], (ids, scores)))
                first = np.lexsort((ids, -scores))[: self.k]
                self.found[i] = ids[first], scores[first]
                if len(first) == self.k:
                    self.bars[i] = scores[first[-1]]

    def rows(self) -> pa.RecordBatch:
        ids, scores = (np.concatenate([x[i] for x in self.found]) for i in (0, 1))
        asker = np.repeat(self.ids, [len(x[0]) for x in self.found])
        return pa.RecordBatch.from_arrays([pa.array(asker), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def top_rows(vectors: DataFrame, queries: DataFrame, k: int = K, candidates: int = CANDIDATES, per_block: int = QUERIES, held: int = HELD) -> DataFrame:
    """(query_id, vec_id, score): the k best of each share of the candidates for every query.

    Both inputs hold (vec_id, vector) of whole numbers. A task holds about `held` blocks of
    queries; a candidate block is moved once for each such group of them, a query block once
    for each share of the candidates. There are as many cells as shuffle partitions, or fewer.
    """
    ask, asked = _blocks(queries, per_block, "queries")
    have, count = _blocks(vectors, candidates, "candidates")
    groups = -(-asked // held)
    shares = max(1, min(count, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups))
    block, group, share = (F.col(name) for name in ("block", "group", "share"))
    every = {name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for name, n in (("group", groups), ("share", shares))}
    rows = [
        ask.withColumns({"group": block % groups, "share": every["share"], "turn": F.lit(0)}),
        have.withColumns({"group": every["group"], "share": block % shares, "turn": F.lit(1)}),
    ]
    cells = [x.select((group * shares + share).cast("int").alias("cell"), "turn", "ids", "vectors", "width") for x in rows]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, room, met = [], {}, False
        for batch in batches:
            for turn, *packed in zip(*(batch.column(name) for name in ("turn", "ids", "vectors", "width"))):
                ids, vectors = _unpacked(*(x.as_py() for x in packed))
                if not turn.as_py():
                    asking.append(Asked(ids, vectors, k))
                    continue
                first = np.arange(len(ids)) % FIRST == 0
                for part in (slice(None),) if met else (first, ~first):
                    lists = SortedLists(ids[part], vectors[part], room)
                    for queries in asking if len(lists.ids) else ():
                        queries.meet(lists)
                met = True
        yield from (queries.rows() for queries in asking)

    # the queries of a cell come first
    dealt = cells[0].union(cells[1]).repartitionById(groups * shares, "cell").sortWithinPartitions("turn")
    return dealt.mapInArrow(search, SCHEMA)


def top_scores(vectors: DataFrame, k: int = K, every: int = 50, **sizes) -> DataFrame:
    """The k best other rows for every vector whose id is divisible by `every`."""
    asking = whole_numbers(vectors.filter(F.col("vec_id").cast("long") % every == 0))
    queries = asking.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    found = top_rows(whole_numbers(vectors), queries, k, **sizes)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank
    FROM rows q JOIN rows c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
