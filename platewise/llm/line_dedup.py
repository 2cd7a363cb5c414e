"""Removal of lines that many documents share.

A line's key is the line without white space at both ends and with A-Z in lower case, as a
128-bit hash: 64 bits to place it, 64 as its fingerprint. A Spark job counts the documents
of every key, adding up within each task first, so a line in a third of all documents is one
row per task. The keys found in enough documents are cut into shards of bounded size, each
compiled into a minimal perfect hash with a fingerprint array and a count array. Documents
probe these arrays; lines are not joined.

While all shards together are below a checked size they go to every executor and each
document is cut where it is read. Beyond it, the hashes of the documents' lines (not the
texts) are sent to their shards in salted parts, probed there, and what they hit comes back
to the document. Both ways give the same rows.

Defined results: a null text is an empty one and both have one empty line; empty keys stay.
A document is a row: a repeated row counts again. Ties and row order play no part. An empty
table gives no rows. Other columns pass through `deduplicated` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.perfect_hash import Shard, shard_block
from platewise.llm.rawtext import SPACES, U, pieces
from platewise.llm.scratch import plainly_named, schema_with, Sent, stored

#: Documents from which on a line goes, and code points that its key needs.
MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Keys of a shard, on average.
SHARD_KEYS = 250_000
#: Bytes of all shards up to which they are sent to every executor.
SEND_BYTES = 64 << 20
#: Lines that one task probes in a shard that is not sent to every executor.
PART_LINES = 1 << 20

_STRIP = bytes(SPACES)
DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_keys(lines: list[bytes], min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Placing hash and fingerprint of each line, and whether its key is long enough.

    `bytes.lower` changes A-Z only.
    """
    keys = [line.strip(_STRIP).lower() for line in lines]
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    long_enough = np.fromiter((len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars) for k in keys), bool, len(keys))
    return digest[:, 0], digest[:, 1], long_enough


def _split(part: pa.RecordBatch) -> tuple[list[list[bytes]], list[bytes]]:
    texts = part.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
    lines = [text.split(b"\n") for text in texts]
    return lines, [line for own in lines for line in own]


def line_counts(docs: DataFrame, min_documents: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, print, documents) of the lines found in at least so many documents."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=16 << 20):
            lines, flat = _split(part)
            key, fingerprint, ok = line_keys(flat, min_chars)
            document = np.repeat(np.arange(len(lines)), [len(own) for own in lines])
            one = pd.DataFrame({"key": key.view(np.int64), "print": fingerprint.view(np.int64), "document": document})[ok].drop_duplicates()
            added = one.groupby(["key", "print"], sort=False).size().reset_index(name="documents")
            yield pa.RecordBatch.from_pandas(added, preserve_index=False)

    found = docs.select(docs["text"].cast("string")).mapInArrow(seen, "key long, print long, documents long")
    return found.groupBy("key", "print").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= min_documents)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def shard_table(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """Stored (shard, block) rows, the number of shards, and the bytes of all blocks."""
    counts = stored(counts, "lines")
    shards = 1 + counts.count() // shard_keys

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard_of(batch.column("key").to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", *batch.schema.names])

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # two keys with equal placing hashes would need 2**32 keys; the rarer one then stays in the texts
        frame = frame.sort_values(["key", "documents"]).drop_duplicates("key", keep="last")
        block = shard_block(frame["key"].to_numpy().view(np.uint64), frame["print"].to_numpy().view(np.uint64), frame["documents"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "block": [block]})

    rows = counts.mapInArrow(numbered, "shard long, key long, print long, documents long")
    blocks = stored(rows.groupBy("shard").applyInPandas(build, "shard long, block binary"), "shards")
    size = blocks.agg(F.sum(F.length("block"))).first()[0] or 0
    return blocks, shards, size


def _probe(shards: dict[int, Shard], count: int, key: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    out, own = np.zeros(len(key), np.int64), _shard_of(key, count)
    for number in np.unique(own):
        if number in shards:
            at = np.flatnonzero(own == number)
            out[at] = shards[number].probe(key[at], fingerprint[at])
    return out


def _cut(part: pa.RecordBatch, drop) -> pa.RecordBatch:
    """The batch with its texts cut and the two counts behind it; drop(lines, row) flags lines."""
    lines, flat = _split(part)
    gone = drop(flat, lines)
    ends = np.cumsum([len(own) for own in lines])
    kept, dropped = [], []
    for own, end in zip(lines, ends):
        flags = gone[end - len(own) : end]
        dropped.append(int(flags.sum()))
        kept.append(b"\n".join(line for line, out in zip(own, flags) if not out).decode() if flags.any() else b"\n".join(own).decode())
    columns = {name: part.column(name) for name in part.schema.names}
    null = part.column("text").is_null().to_numpy(zero_copy_only=False)
    columns["text"] = pa.array([None if n else k for n, k in zip(null, kept)], pa.string())
    columns[LINES] = pa.array([len(own) for own in lines], pa.int64())
    columns[DROPPED] = pa.array(dropped, pa.int64())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# Names for columns behind those of the documents, which may have any.
LINES, DROPPED, ROW, HITS = "__lines", "__dropped", "__row", "__hits"


def line_deduplicated(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, send_bytes: int = SEND_BYTES, part_lines: int = PART_LINES
) -> DataFrame:
    """The documents with shared lines cut from `text`, and `__lines`, `__dropped` behind their columns.

    Columns that the documents have under these names, or `__row` and `__hits`, are left out.
    """
    docs = docs.drop(LINES, DROPPED, ROW, HITS)
    docs = docs.withColumn("text", docs["text"].cast("string"))
    blocks, shards, size = shard_table(line_counts(docs, min_documents, min_chars), shard_keys)
    schema = schema_with(docs, **{LINES: "long", DROPPED: "long"})
    if size <= send_bytes:
        sent = Sent(docs.sparkSession, [(r.shard, bytes(r.block)) for r in blocks.toLocalIterator()], lambda rows: {n: Shard(b) for n, b in rows})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.get()

            def drop(flat: list[bytes], lines: list[list[bytes]]) -> np.ndarray:
                key, fingerprint, ok = line_keys(flat, min_chars)
                return ok & (_probe(own, shards, key, fingerprint) >= min_documents)

            for part in pieces(batches):
                yield _cut(part, drop)

        return docs.mapInArrow(run, schema)
    return _routed(docs, blocks, shards, min_documents, min_chars, part_lines).select(*docs.columns, LINES, DROPPED)


def without_shared_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents with shared lines cut from `text` and all else as it was, whatever the columns are called."""
    plain, named = plainly_named(docs, "doc_id", "text")
    return named(line_deduplicated(plain, **how).select(*plain.columns))


def _routed(docs: DataFrame, blocks: DataFrame, shards: int, min_documents: int, min_chars: int, part_lines: int = PART_LINES) -> DataFrame:
    """The way for shards of any size: line hashes travel to the shards, hits travel back.

    The lines of a shard are dealt by hash over parts of about `part_lines`. Texts are told apart by a 128-bit digest, so equal texts share their hits.
    """
    row = F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            lines, flat = _split(part)
            key, fingerprint, ok = line_keys(flat, min_chars)
            at = np.repeat(np.arange(len(lines)), [len(own) for own in lines])[ok]
            arrays = [_shard_of(key, shards)[ok], key.view(np.int64)[ok], fingerprint.view(np.int64)[ok]]
            yield pa.RecordBatch.from_arrays([part.column(ROW).take(pa.array(at)), *map(pa.array, arrays)], names=[ROW, "shard", "key", "print"])

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({ROW: [], "key": []}).astype({"key": "int64", ROW: "object"})
        counts = Shard(right["block"].iloc[0]).probe(left["key"].to_numpy().view(np.uint64), left["print"].to_numpy().view(np.uint64))
        return left.loc[counts >= min_documents, [ROW, "key"]].drop_duplicates()

    texts = docs.select("text", row.alias(ROW))
    # equal texts and lines send a hash once, so a crowd of copies is one row of each
    sent = stored(texts.mapInArrow(hashes, f"{ROW} string, shard long, key long, print long").distinct(), "sent")
    parts = stored(sent.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(part_lines)).alias("parts")), "parts")
    sent = sent.join(parts, "shard").withColumn("salt", F.pmod(F.xxhash64(ROW, "key"), "parts")).drop("parts")
    # a shard is copied to as many parts as its lines need
    arrays = blocks.join(parts, "shard").select("shard", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    hits = sent.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(probe, f"{ROW} string, key long")
    hits = hits.groupBy(ROW).agg(F.collect_set("key").alias(HITS))
    joined = docs.withColumn(ROW, row).join(hits, ROW, "left").select(*docs.columns, HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            own = part.column(HITS).to_pylist()
            part = part.select([n for n in part.schema.names if n != HITS])

            def drop(flat: list[bytes], lines: list[list[bytes]]) -> np.ndarray:
                key, _, ok = line_keys(flat, min_chars)
                gone, at = np.zeros(len(flat), bool), 0
                for hit, mine in zip(own, lines):
                    if hit:
                        stop = at + len(mine)
                        gone[at:stop] = ok[at:stop] & np.isin(key[at:stop].view(np.int64), np.array(hit, np.int64))
                    at += len(mine)
                return gone

            yield _cut(part, drop)

    return joined.mapInArrow(run, schema_with(docs, **{LINES: "long", DROPPED: "long"}))


def line_digest(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, **how) -> DataFrame:
    """One row per document: lines before, lines dropped, digest of what stays."""
    done = line_deduplicated(docs.select(docs["doc_id"].cast("long"), "text"), min_documents, min_chars, **how)
    return done.select(
        "doc_id", F.col(LINES).alias("n_lines"), F.col(DROPPED).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
