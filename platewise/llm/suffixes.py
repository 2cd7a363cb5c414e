"""Removal of byte strings that stand anywhere else in the corpus.

Every byte that a window of SPAN bytes covers goes if the same window starts at any other
place. Windows are not counted one by one. Each window has an anchor, the place of the least
hash among its k-byte strings, which equal windows share; about one place in seventy is one.
The windows of an anchor make up its context, some 270 bytes. Spark counts the k-byte strings
at anchors and then whole contexts by their hashes, added up within each task first, so that
copies are one row per task however many there are. A context found again goes as a whole.

What is left are contexts that differ but share their anchor string: the borders of repeated
passages. Only these are cut from the texts and sorted in parts of bounded size: a mergesort
of the suffixes at the anchors, and of the reversed bytes before them. Two suffixes are
compared by binary search for their common extension on prefix polynomial hashes; each sorted
neighbour's common extension is then verified byte by byte. A window is repeated where two
suffixes agree as far to the right, and as far to the left, as the window reaches. An anchor
string with very many contexts is not put into one part: its windows are counted by their
hashes in an aggregate instead.

Defined results: a null text is an empty one. Texts under SPAN bytes lose nothing. Repeated
rows are documents of their own, so each loses all that is long enough. Ties play no part. An
empty table gives no rows. Other columns pass through `without_repeats` untouched; there, a
character of which some bytes go is dropped whole, and a null text stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.rawtext import HASHED, U, Prefixes, joined, mix, pieces
from platewise.llm.scratch import plainly_named, schema_with, stored

SPAN = 200
#: Length of the strings whose least hash is a window's anchor.
ANCHOR = 64
#: Contexts sorted together, on average, and contexts of one anchor string up to which they are.
PART = 10_000
#: Bytes of a text that are looked at together; parts of longer texts overlap by SPAN - 1.
SEGMENT = 1 << 22
PLACE_BITS = 24

ANCHORS = "anchor long, context long, doc_id long, text_hash long, start long, left int, length int"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    size = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:size], before[width - 1 : width - 1 + size])


def anchors(texts: pa.Array, span: int = SPAN, size: int = ANCHOR) -> dict[str, np.ndarray]:
    """Anchors of all texts: text number, hashes of string and context, context start, bytes before the anchor, length."""
    data, starts, ends = joined(texts)
    names = ("text", "anchor", "context", "start", "left", "length")
    found: list[list[np.ndarray]] = [[] for _ in names]
    # whole texts go together; a longer one is looked at in overlapping segments
    units = [(0, len(data))] if len(data) <= SEGMENT else [
        (s + at, min(e, s + at + SEGMENT)) for s, e in zip(starts, ends) for at in range(0, max(1, e - s - span + 1), SEGMENT - span + 1)
    ]
    for low, high in units:
        if high - low < span:
            continue
        part = data[low:high]
        prefixes = Prefixes(part)
        place = np.arange(len(part) - size + 1)
        strings = mix(prefixes.of(place, place + size))
        ranked = strings >> U(PLACE_BITS) << U(PLACE_BITS) | place.astype(np.uint64)
        least = (_sliding_least(ranked, span - size + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        text = np.searchsorted(ends, np.arange(low, high - span + 1), "right")
        inside = np.flatnonzero(np.arange(low, high - span + 1) + span <= ends[text])
        inside = inside[starts[text[inside]] <= inside + low]
        least, text = least[inside], text[inside]
        if not len(least):
            continue
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(least)) - 1
        first, last, at = inside[head], inside[tail], least[head]
        length, left = last - first + span, at - first
        context = mix(prefixes.of(first, first + length) + U(0x9E3779B97F4A7C15) * (length * 1024 + left).astype(np.uint64))
        for column, values in zip(found, (text[head], strings[at], context, first + low - starts[text[head]], left, length)):
            column.append(values)
    return {name: np.concatenate(column) if column else np.zeros(0, np.int64) for name, column in zip(names, found)}


def keyed(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def anchor_table(docs: DataFrame, span: int = SPAN, size: int = ANCHOR) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=HASHED):
            found = anchors(part.column("text"), span, size)
            at = pa.array(found["text"])
            hashes = [pa.array(found[n].astype(np.uint64).view(np.int64)) for n in ("anchor", "context")]
            columns = [*hashes, part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(found["start"])]
            columns += [pa.array(found[n].astype(np.int32)) for n in ("left", "length")]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "doc_id", "text_hash", "start", "left", "length"])

    return keyed(docs).mapInArrow(run, ANCHORS)


class Suffixes:
    """Suffixes of a byte buffer, each of limited length, compared within groups."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray, groups: np.ndarray):
        self.data, self.starts, self.limits, self.groups = data, starts, limits, groups
        self.prefixes = Prefixes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.limits[a], self.limits[b])
        left, right = self.starts[a], self.starts[b]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) >> 1
            one, two = left[open_], right[open_]
            same = self.prefixes.of(one, one + middle) == self.prefixes.of(two, two + middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; an end sorts before any byte, equal ones by number."""
        length = self.common(a, b)
        end_a, end_b = length == self.limits[a], length == self.limits[b]
        last = len(self.data) - 1
        byte_a = self.data[np.minimum(self.starts[a] + length, last)]
        byte_b = self.data[np.minimum(self.starts[b] + length, last)]
        return np.where(end_a & end_b, a < b, np.where(end_a | end_b, end_a, byte_a < byte_b))

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffix numbers by group and text, and each one's common extension with the one before in its group."""
        order = np.argsort(self.groups, kind="stable")
        ordered = self.groups[order]
        head = np.ones(len(order), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(order)))
        begin, size = np.repeat(begin, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            slots = np.flatnonzero(size > width)
            place = slots - begin[slots]
            run = place // width
            sibling = (run ^ 1) * width
            there = np.clip(size[slots] - sibling, 0, width)
            low, high = np.zeros(len(slots), np.int64), there
            me = order[slots]
            while True:  # how many of the sibling run sort before each suffix
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                before = self.less(order[begin[slots[open_]] + sibling[open_] + middle], me[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            merged = order.copy()
            merged[begin[slots] + np.minimum(run, run ^ 1) * width + place - run * width + low] = me
            order, width = merged, 2 * width
        extension = np.zeros(len(order), np.int64)
        inner = np.flatnonzero(~head)
        extension[inner] = self.common(order[inner - 1], order[inner])
        if not self._verified(order, extension, inner):
            return self._sorted_plainly(head)
        return order, extension

    def _verified(self, order: np.ndarray, extension: np.ndarray, inner: np.ndarray) -> bool:
        """Whether neighbours truly agree so far and no further, and stand in order."""
        reach = np.arange(int(self.limits.max(initial=0)) + 1)
        last = len(self.data) - 1
        for i in range(0, len(inner), 1 << 12):
            at = inner[i : i + (1 << 12)]
            a, b, length = order[at - 1], order[at], extension[at]
            one = self.data[np.minimum(self.starts[a][:, None] + reach, last)]
            two = self.data[np.minimum(self.starts[b][:, None] + reach, last)]
            if ((one != two) & (reach < length[:, None])).any():
                return False
            more = (length < self.limits[a]) & (length < self.limits[b])
            rows = np.flatnonzero(more)
            if (one[rows, length[rows]] >= two[rows, length[rows]]).any() or (~more & (self.limits[a] > self.limits[b])).any():
                return False
        return True

    def _sorted_plainly(self, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After a collision of hashes: the same by comparing bytes."""
        text = [self.data[s : s + n].tobytes() for s, n in zip(self.starts, self.limits)]
        order = np.array(sorted(range(len(text)), key=lambda i: (self.groups[i], text[i], i)), np.int64)
        extension = np.zeros(len(order), np.int64)
        for i in np.flatnonzero(~head):
            a, b = text[order[i - 1]], text[order[i]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
            extension[i] = differ[0] if len(differ) else n
        return order, extension


def repeated_windows(groups: np.ndarray, contexts: list[bytes], left: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts: first and last distance (window start to anchor) of its windows that another holds; -1 if none.

    Windows are looked at by distance. Those of one group and distance are equal if their
    suffixes are in one run of the sorted order that agrees as far as the window reaches to
    the right, and their reversed beginnings in one that agrees as far to the left.
    """
    length = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(length) - length
    right = length - left
    order_r, same_r = Suffixes(data, begin + left, right, groups).sorted()
    order_l, same_l = Suffixes(data[::-1].copy(), len(data) - begin - left, left, groups).sorted()
    rank_r, rank_l = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    rank_r[order_r], rank_l[order_l] = np.arange(len(left)), np.arange(len(left))
    heads = np.ones(len(left), bool)
    heads[1:] = groups[order_r][1:] != groups[order_r][:-1]  # both orders have the groups alike
    least, most = np.full(len(left), -1, np.int64), np.full(len(left), -1, np.int64)
    for distance in range(int(left.max(initial=-1)) + 1):
        here = np.flatnonzero((left >= distance) & (right >= span - distance))
        if len(here) < 2:
            continue
        run_r = np.cumsum(heads | (same_r < span - distance))
        run_l = np.cumsum(heads | (same_l < distance))
        key = run_r[rank_r[here]] * np.int64(len(left) + 1) + run_l[rank_l[here]]
        by = np.argsort(key)
        ordered = key[by]
        again = np.zeros(len(key), bool)
        equal = ordered[1:] == ordered[:-1]
        again[by[1:][equal]] = True
        again[by[:-1][equal]] = True
        hit = here[again]
        most[hit] = distance
        least[hit[least[hit] < 0]] = distance
    return least, most


FOUND = "anchor long, context long, low int, high int"


def _border_contexts(borders: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the bytes of each context: the texts that hold one are read again, and cut."""
    own = borders.groupBy("one.doc_id", "one.text_hash").agg(
        F.collect_list(F.struct("anchor", "context", "kinds", F.col("one.start").alias("start"), F.col("one.left").alias("left"), F.col("one.length").alias("length"))).alias("cuts")
    )
    d, o = keyed(docs).alias("d"), own.alias("o")
    texts = d.join(o, F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_hash") == F.col("o.text_hash"))).select("text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            data, starts, _ = joined(part.column("text"))
            cuts = part.column("cuts")
            row = np.repeat(np.arange(part.num_rows), cuts.value_lengths().to_numpy(zero_copy_only=False))
            flat = dict(zip(["anchor", "context", "kinds", "start", "left", "length"], cuts.flatten().flatten()))
            start = starts[row] + flat["start"].to_numpy(zero_copy_only=False)
            length = flat["length"].to_numpy(zero_copy_only=False)
            content = [data[s : s + n].tobytes() for s, n in zip(start, length)]
            columns = [flat["anchor"], flat["context"], flat["kinds"], flat["left"], pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "kinds", "left", "content"])

    return texts.mapInArrow(run, "anchor long, context long, kinds long, left int, content binary")


def _sorted_parts(contexts: DataFrame, parts: int, span: int) -> DataFrame:
    """What repeats in each context, by the suffix order of parts that hold whole groups."""

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["anchor", "context"]).reset_index(drop=True)
        low, high = repeated_windows(frame["anchor"].to_numpy(), list(frame["content"]), frame["left"].to_numpy(np.int64), span)
        hit = high >= 0
        left = frame["left"].to_numpy(np.int64)
        out = frame.loc[hit, ["anchor", "context"]]
        # distances count back from the anchor: the farthest window begins first
        return out.assign(low=(left - high)[hit].astype(np.int32), high=(left - low + span)[hit].astype(np.int32))

    part = F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("part")
    return contexts.select(part, "anchor", "context", "left", "content").groupBy("part").applyInPandas(search, FOUND)


def _counted_windows(contexts: DataFrame, span: int) -> DataFrame:
    """The same for anchor strings with very many contexts: every window's hash is counted.

    Sums are added up within tasks, so no group meets in one of them.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                content = part.column("content")
                length = np.fromiter((len(c.as_py()) for c in content), np.int64, part.num_rows)
                data = np.frombuffer(b"".join(c.as_py() for c in content), np.uint8)
                one, two = Prefixes(data), Prefixes(data ^ 0x55)
                count = length - span + 1
                row = np.repeat(np.arange(part.num_rows), count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = (np.cumsum(length) - length)[row] + at
                hashes = [pa.array(mix(p.of(start, start + span)).view(np.int64)) for p in (one, two)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("anchor").take(rows), part.column("context").take(rows), pa.array(at.astype(np.int32)), *hashes], names=["anchor", "context", "at", "w1", "w2"])

    each = stored(contexts.dropDuplicates(["anchor", "context"]).mapInArrow(windows, "anchor long, context long, at int, w1 long, w2 long"), "windows")
    again = stored(each.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "repeated")
    found = each.join(again, ["w1", "w2"]).groupBy("anchor", "context")
    return found.agg(F.min("at").alias("low"), (F.max("at") + span).cast("int").alias("high"))


def repeats(docs: DataFrame, span: int = SPAN, size: int = ANCHOR, part: int = PART) -> DataFrame:
    """(doc_id, text_hash, spans): the byte ranges of each document that repeat, not yet merged.

    Stages are written in turn, so the files of one shuffle go before the next.
    """
    every = stored(anchor_table(docs, span, size), "anchors")
    shared = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "shared")
    places = stored(every.join(shared, "anchor"), "places")
    one = F.min(F.struct("doc_id", "text_hash", "start", "left", "length")).alias("one")
    kinds = stored(places.groupBy("anchor", "context").agg(F.count("*").alias("n"), one), "contexts")
    several = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "several")
    # a context that occurs again goes whole; one that does not may share windows with others of its anchor
    whole = kinds.filter("n > 1").select("anchor", "context", F.lit(0).alias("low"), F.col("one.length").alias("high"))
    # those that go whole are needed here too, as what the others are compared with
    border = stored(_border_contexts(kinds.join(several, "anchor"), docs), "borders")
    few, many = border.filter(F.col("kinds") <= part), border.filter(F.col("kinds") > part)
    parts = 1 + few.count() // max(part, 1)
    found = _sorted_parts(few, parts, span)
    if not many.isEmpty():
        found = found.union(_counted_windows(many, span))
    found = found.join(kinds.filter("n = 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    found = stored(whole.union(found), "found")
    ranges = F.struct((F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("stop"))
    return places.join(found, ["anchor", "context"]).groupBy("doc_id", "text_hash").agg(F.collect_set(ranges).alias("__spans"))


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the ranges, touching ones together."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        if out and starts[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(stops[i]))
        else:
            out.append([int(starts[i]), int(stops[i])])
    return [tuple(x) for x in out]


def _with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All rows of docs, with `__spans` where something repeats."""
    found = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "__spans")
    own = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__hash"))
    return own.join(found, on, "left").select(*docs.columns, "__spans")


def _spans(part: pa.RecordBatch) -> Iterator[list[tuple[int, int]]]:
    spans = part.column("__spans")
    for i in range(part.num_rows):
        own = spans[i].values if spans[i].is_valid else None
        if own is None or not len(own):
            yield []
        else:
            start, stop = own.flatten()
            yield merged(start.to_numpy(), stop.to_numpy())


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(stop for _, stop in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(start for start, _ in spans), len(data)]))


def without_repeats(docs: DataFrame, span: int = SPAN, size: int = ANCHOR, part: int = PART) -> DataFrame:
    """The documents with repeated byte strings cut from `text`, all columns kept."""
    docs, named = plainly_named(docs.withColumn("text", docs["text"].cast("string")), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = piece.column("text").cast(pa.large_binary()).to_pylist()
            cut = [None if t is None else _kept(t, s).decode("utf-8", "ignore") for t, s in zip(texts, _spans(piece))]
            columns = [pa.array(cut, pa.string()) if n == "text" else piece.column(n) for n in piece.schema.names if n != "__spans"]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in piece.schema.names if n != "__spans"])

    return named(_with_spans(docs, repeats(docs, span, size, part)).mapInArrow(run, schema_with(docs)))


def removed_digest(docs: DataFrame, span: int = SPAN, size: int = ANCHOR, part: int = PART) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, digest of what stays."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows: list[list] = [[], [], [], []]
            for text, spans in zip(piece.column("text").fill_null("").cast(pa.large_binary()).to_pylist(), _spans(piece)):
                removed = sum(stop - start for start, stop in spans)
                for column, value in zip(rows, (len(text), removed, len(spans), hashlib.sha256(_kept(text, spans)).hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *map(pa.array, rows, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, repeats(docs, span, size, part)).mapInArrow(run, DIGEST)
