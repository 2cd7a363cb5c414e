"""Quality classifier from weak labels.

Overlapping labellers each call a document bad or say nothing; one more is the table of given
labels, which covers some documents and calls them good or bad. Expectation-maximisation
estimates the labellers' accuracies where they overlap, and from those the probability that a
document of the training sample is bad. These posterior labels train a linear scorer on hashed words
and word beginnings. The labellers are used in training only; every document is judged by
the scorer on its whole text.

The sample is bounded: about `SAMPLE` labelled documents by a hash of the id.

Defined results: a text that is null or has no letters is rejected with quality 0. Without
labels the sample is of any documents: the other labellers decide, and one on whom none
speaks is called good; without any document to learn from nothing is
rejected but such texts. Several labels of one document count as the worst of them. Repeated
rows and ties are judged alike, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.quality_rules import Limits, measures
from platewise.llm.rawtext import HASHED, LOWER, U, Prefixes, joined, mix, per_text, pieces
from platewise.llm.scratch import plainly_named, schema_with, Sent

#: Labelled documents that are learned from, about.
SAMPLE = 12_000
#: Hashed features; the first RESERVED are the buckets of the measured shares.
FEATURES = 1 << 20
RESERVED = 256
#: Leading bytes of a word that are features besides the whole word.
BEGINNINGS = (4, 5, 6)
#: A feature is used if the bad documents among those that have it are so many standard
#: deviations from what the share of bad documents lets expect.
FEATURE_DEVIATIONS = 5.0
ROUNDS = 300
#: Probability of being bad from which on a document is rejected.
REJECT = 0.5

SCHEMA = "doc_id long, quality double, kept boolean"
SHARES = ("few_words", "symbols", "capitals", "exclamations", "digits", "repeated", "repeated_lines", "word_length")
#: A labeller calls a document bad from this share on.
CALLS = {"few_words": 0.9, "symbols": 0.1, "capitals": 0.5, "exclamations": 0.3, "digits": 0.5, "repeated": 0.5, "repeated_lines": 0.5, "word_length": 0.95}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_kinds = np.zeros((3, 256), bool)
_kinds[0, 65:91] = _kinds[1, ord("!")] = _kinds[2, 48:58] = True


def shares(texts: pa.Array) -> np.ndarray:
    """What the labellers look at: one row per text, a column of 0 to 1 for each of SHARES."""
    data, starts, ends = joined(texts)
    own = measures(texts, Limits(top_shares={}, repeated_shares={}))
    words = np.maximum(own["n_words"], 1)
    sums = np.zeros((4, len(data) + 1), np.int64)
    for row, kind in enumerate([*_kinds, _LETTER]):
        np.cumsum(kind[data], out=sums[row, 1:])
    capitals, exclamations, digits, letters = sums[:, ends] - sums[:, starts]
    return np.stack(
        [
            np.exp(-own["n_words"] / 100),
            np.minimum(own["n_symbols"] / words, 1),
            capitals / np.maximum(letters, 1),
            np.minimum(exclamations / words, 1),
            digits / np.maximum(ends - starts, 1),
            own["n_repeat_words"] / words,
            own["line_share"],
            1 - np.exp(-own["word_chars"] / words / 10),
        ],
        axis=1,
    )


def features(texts: pa.Array, measured: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order; with `wanted`, only features of that mask."""
    data, starts, ends = joined(texts)
    data = LOWER[data]
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _LETTER[data]
    begin = letter[1:-1] & ~letter[:-2]
    finish = letter[1:-1] & ~letter[2:]
    full = starts < ends
    begin[starts[full]] = letter[1:-1][starts[full]]
    finish[ends[full] - 1] = letter[1:-1][ends[full] - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    text = np.searchsorted(ends, first, "right")
    prefixes = Prefixes(data)
    found = []
    for kind, reach in enumerate([0, *BEGINNINGS]):
        at = np.flatnonzero(last - first > reach) if reach else np.arange(len(first))
        stop = first[at] + reach if reach else last[at]
        feature = RESERVED + (mix(prefixes.of(first[at], stop) + U(kind)) % U(FEATURES - RESERVED)).astype(np.int64)
        found.append((text[at], feature))
    bucket = np.minimum((measured * 16).astype(np.int64), 15) + 16 * np.arange(len(SHARES))
    found.append((np.repeat(np.arange(len(starts)), len(SHARES)), bucket.ravel()))
    pairs = [t.astype(np.int64) * FEATURES + f if wanted is None else (t.astype(np.int64) * FEATURES + f)[wanted[f]] for t, f in found]
    pairs = np.unique(np.concatenate(pairs))
    return pairs // FEATURES, pairs % FEATURES


def posterior(calls: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each document is bad, and each labeller's accuracy.

    `calls` has a column per labeller: 1 bad, 0 good, -1 nothing. An accuracy is the share of
    a labeller's calls that are right; those who say nothing leave a document's odds as they
    are. Accuracies, the share of bad documents and the probabilities are estimated in turn.
    """
    spoken, sign = calls >= 0, np.where(calls == 1, 1.0, -1.0)
    accuracy, prior = np.full(calls.shape[1], 0.8), 0.3
    bad = np.full(len(calls), prior)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        bad = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (spoken * sign) @ weight, -30, 30)))
        right = np.where(calls == 1, bad[:, None], 1 - bad[:, None])
        accuracy = np.clip(((right * spoken).sum(axis=0) + 0.8) / (spoken.sum(axis=0) + 1), 0.05, 0.99)
        prior = float(np.clip(bad.mean(), 0.01, 0.99)) if len(bad) else prior
    return bad, accuracy


#: Documents of the sample whose features are unpacked at once.
CHUNK = 1000


def _pairs(lists: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of a chunk of the sample's feature lists."""
    part = lists.slice(start, CHUNK)
    sizes = part.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(start, start + len(part)), sizes), part.flatten().to_numpy(zero_copy_only=False)


def trained(lists: pa.Array, bad: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by adaptive gradient steps on the soft labels.

    `lists` holds each document's distinct features.
    """
    weights = np.zeros(FEATURES, np.float32)
    if not len(bad):
        return weights, 0.0
    documents, in_bad = np.zeros(FEATURES), np.zeros(FEATURES)
    for start in range(0, len(bad), CHUNK):
        numbers, found = _pairs(lists, start)
        documents += np.bincount(found, minlength=FEATURES)
        in_bad += np.bincount(found, weights=bad[numbers], minlength=FEATURES)
    share = float(np.clip(bad.mean(), 0.01, 0.99))
    use = np.abs(in_bad - documents * share) >= FEATURE_DEVIATIONS * np.sqrt(np.maximum(documents, 1) * share * (1 - share))
    use[:RESERVED] = documents[:RESERVED] > 0
    index = np.cumsum(use) - 1
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(bad), CHUNK):
        numbers, found = _pairs(lists, start)
        wanted = use[found]
        kept.append((numbers[wanted], index[found[wanted]]))
    rows, columns = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
    w, bias = np.zeros(int(use.sum())), np.log(share / (1 - share))
    square, bias_square = np.full(len(w), 1e-6), 1e-6
    for _ in range(rounds):
        margin = bias + np.bincount(rows, weights=w[columns], minlength=len(bad))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - bad
        slope = np.bincount(columns, weights=error[rows], minlength=len(w)) + 0.02 * w
        square += slope**2
        w -= 0.2 * slope / np.sqrt(square)
        bias_square += error.sum() ** 2
        bias -= 0.2 * error.sum() / np.sqrt(bias_square)
    weights[use] = w
    return weights, float(bias)


def _sampled(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """text and label (1 bad, 0 good, -1 none) of the training sample: labelled documents, or any if there are none."""
    label = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("label")
    labels = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label)
    at = F.xxhash64("doc_id", F.lit("sample")) / float(1 << 64) + 0.5
    docs = docs.filter("text IS NOT NULL")
    share = lambda rows, wanted: min(1.0, wanted / max(1, rows.count()))
    mine = docs.filter(at < share(labels, size)).join(labels.filter(at < share(labels, size)), "doc_id").select("text", "label")
    return mine if not mine.isEmpty() else docs.filter(at < share(docs, size)).select("text", F.lit(-1).alias("label"))


def fitted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer. Executors measure the sample's texts; what they send back is bounded with the sample."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=HASHED):
            measured = shares(part.column("text"))
            numbers, found = features(part.column("text"), measured)
            ends = np.cumsum(per_text(numbers, part.num_rows))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            called = pa.array([row.tolist() for row in measured >= np.array([CALLS[s] for s in SHARES])], pa.list_(pa.bool_()))
            columns = [part.column("label"), called, pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "called", "found"])

    sample = _sampled(docs, labels, size).mapInArrow(seen, "label int, called array<boolean>, found array<int>").toArrow()
    given = sample.column("label").to_numpy()
    called = np.array(sample.column("called").to_pylist(), bool).reshape(-1, len(SHARES))
    unremarkable = np.where((given < 0) & ~called.any(axis=1), 0, -1)
    calls = np.column_stack([np.where(called, 1, -1), unremarkable, given]).astype(np.int64)
    lists = pa.concat_arrays(sample.column("found").chunks) if len(given) else pa.array([], pa.list_(pa.int32()))
    return trained(lists, posterior(calls)[0])


QUALITY, KEPT = "__quality", "__kept"


def scored(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """The documents with `__quality` (1 minus the probability of being bad) and `__kept` behind their columns.

    Columns that the documents have under these names are left out.
    """
    docs = docs.drop(QUALITY, KEPT)
    text = docs["text"].cast("string")
    docs = docs.withColumn("text", text)
    model = Sent(docs.sparkSession, fitted(docs.select(docs["doc_id"].cast("long"), "text"), labels, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.get()
        for part in pieces(batches, limit=HASHED):
            texts = part.column("text")
            numbers, found = features(texts, shares(texts), weights != 0)
            margin = bias + np.bincount(numbers, weights=weights[found], minlength=part.num_rows)
            data, starts, ends = joined(texts)
            letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
            quality = np.where(letters[ends] > letters[starts], 1 / (1 + np.exp(np.clip(margin, -30, 30))), 0.0)
            columns = [*part.columns, pa.array(quality), pa.array(quality > 1 - reject)]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, QUALITY, KEPT])

    return docs.mapInArrow(run, schema_with(docs, **{QUALITY: "double", KEPT: "boolean"}))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the scorer keeps, as they were, whatever their columns are called."""
    plain, named = plainly_named(docs, "doc_id", "text")
    return named(scored(plain, labels, **how).filter(F.col(KEPT)).select(*plain.columns))


def quality_verdicts(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """One row per document with its quality and whether it is kept."""
    rows = scored(docs.select(docs["doc_id"].cast("long"), "text"), labels, size)
    return rows.select("doc_id", F.col(QUALITY).alias("quality"), F.col(KEPT).alias("kept"))
