"""Near-duplicate groups by b-bit MinHash.

A text's set holds its distinct shingles of five words. Texts with equal sets are one class.
Of each class, the minima under many hash functions give band keys, whose equality makes
candidates, and their low bits, packed into a few integers. From the packed bits of two
classes the share of equal minima is counted and corrected for minima that agree by chance
in the bits kept; pairs that this estimate puts far below the threshold are left out (five
standard deviations), all others are confirmed on the full sets.

Candidates are not expanded into all pairs. In two rounds each band bucket links its members
to one of them: first to the one whose own buckets are largest, as the original of a group of
copies has, then to any. A last round takes the members of a bucket that are still outside
its largest component against those in other components, unless the shingles that any other
set shares with them are too few for the threshold, which is an exact bound. So every two
classes that share a bucket end in one component or have been compared or ruled out.

Defined results: a text without words, or null, has no set, is linked with nothing and is its
own component. Fewer words than five make one shingle. Words keep everything but the case of
A-Z. Repeated rows are documents of one class; a component is named by its smallest doc_id,
nulls aside. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.graph import components
from platewise.llm.rawtext import HASHED, LOWER, U, Prefixes, joined, mix, per_text, pieces, words
from platewise.llm.scratch import plainly_named, stored

WORDS = 5
#: Percent of the union that two sets must share.
PERCENT = 85
#: Hash functions; the first BANDS * ROWS make the bands. At a similarity of 0.85 two classes
#: miss each other in all bands with probability 1e-5. All of them make the estimate, whose
#: standard deviation there is 0.02.
HASHES = 384
BANDS, ROWS = 20, 5
#: Low bits kept of each minimum: two, in 64-bit words.
BITS = 2
STAR_ROUNDS = 2

_random = np.random.default_rng(17)
_FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) | U(1)
_TERMS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
SIGNATURES = "doc_id long, text_hash long, n_shingles long, shingles binary, bands array<long>, bits array<long>"


def least_agreement(percent: int = PERCENT, deviations: float = 5.0) -> int:
    """Equal low-bit values, of HASHES, below which a pair cannot reasonably reach the threshold."""
    chance = 1 / (1 << BITS)
    share = percent / 100 + (1 - percent / 100) * chance
    return int(np.floor(HASHES * share - deviations * np.sqrt(HASHES * share * (1 - share))))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text; where each text's begin; how many it has."""
    data, starts, ends = joined(texts)
    data = LOWER[data]
    first, last, text = words(data, starts, ends)
    hashes = mix(Prefixes(data).of(first, last) ^ mix((last - first).astype(np.uint64)))
    count = per_text(text, len(starts))
    total = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        total = total * U(0x9E3779B97F4A7C15) + hashes[i : i + len(total)]
    whole = np.flatnonzero(text[: len(total)] == text[WORDS - 1 :]) if len(total) else np.zeros(0, np.int64)
    shingles, owner = mix(total[whole]), text[whole]
    before = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < WORDS))
    own = np.zeros(len(short), np.uint64)
    for i in range(WORDS - 1):
        more = i < count[short]
        own[more] = own[more] * U(0x9E3779B97F4A7C15) + hashes[before[short[more]] + i]
    shingles = np.concatenate([shingles, mix(own ^ mix(count[short].astype(np.uint64)))])
    owner = np.concatenate([owner, short])
    order = np.argsort(shingles, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, size = shingles[new], per_text(owner[new], len(starts))
    return shingles, np.cumsum(size) - size, size


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: size and digest of its set, band keys, packed low bits of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=HASHED):
            shingles, begin, size = shingle_sets(part.column("text"))
            full = np.flatnonzero(size)
            minima = np.zeros((part.num_rows, HASHES), np.uint64)
            digest = np.zeros((part.num_rows, 2), np.uint64)
            if len(full):
                cuts = begin[full]
                for i in range(HASHES):
                    minima[full, i] = np.minimum.reduceat(shingles * _FACTORS[i] + _TERMS[i], cuts)
                # sums over the set, which order does not change
                digest[full, 0] = np.add.reduceat(mix(shingles), cuts)
                digest[full, 1] = np.add.reduceat(mix(shingles ^ U(0x5851F42D4C957F2D)), cuts)
            keys = np.zeros((part.num_rows, BANDS), np.uint64)
            for row in range(ROWS):
                keys = mix(keys * U(0x9E3779B97F4A7C15) + minima[:, row : BANDS * ROWS : ROWS])
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
            low = (minima >> U(7)) & U((1 << BITS) - 1)
            lanes = low.reshape(part.num_rows, -1, 64 // BITS) << (U(BITS) * np.arange(64 // BITS, dtype=np.uint64))
            packed = np.bitwise_or.reduce(lanes, axis=2)
            lists = lambda table: pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel().view(np.int64)))
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(size), pa.array([d.tobytes() for d in digest], pa.binary()), lists(keys), lists(packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "shingles", "bands", "bits"])

    return keyed(docs).mapInArrow(run, SIGNATURES)


def keyed(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def agreement(a: Column, b: Column) -> Column:
    """How many of the packed low-bit values two signatures share."""
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(HASHES) - differ


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def class_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set) of the classes in `ids`. Only these classes' texts leave their place."""
    wanted = classes.join(ids, "id", "left_semi").select("id", "one.*")
    # null ids join too: a class of documents without an id is one like any other
    texts = keyed(docs).alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, limit=HASHED):
            shingles, begin, size = shingle_sets(part.column("text"))
            offsets = pa.array(np.append(begin, len(shingles)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "set"])

    # repeated rows bring a set more than once
    return stored(texts.select("id", "text").mapInArrow(run, "id long, set array<long>").dropDuplicates(["id"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) of classes whose full sets are similar enough."""
    left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in ("x", "y"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y")
    shared = F.size(F.array_intersect("set_x", "set_y"))
    return both.filter(shared * 100 >= (F.size("set_x") + F.size("set_y") - shared) * percent).select("x", "y")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(id, shared): how many of a set's shingles any other of these sets has as well."""
    holders = sets.select("id", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    own = holders.filter("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    return sets.select("id", F.size("set").alias("n")).join(own, "id", "left").select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))


def class_components(classes: DataFrame, docs: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame | None:
    """(id, label) of the classes that are linked with others; None if there are none."""
    enough = least_agreement(percent)
    info = classes.select("id", "n_shingles", "bits")
    members = classes.select("id", F.posexplode("bands").alias("band", "key")).select("id", "key")
    crowded = stored(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = stored(members.join(crowded, "key"), "members")
    # a class whose buckets are large is like many others: the original of a group of copies
    weights = stored(members.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    members = stored(members.join(weights, "id").select("id", "key", "weight"), "members")
    sets = class_sets(weights, classes, docs)
    edges, labels = None, None

    def labelled(rows: DataFrame, *names: str) -> DataFrame:
        """Adds each id's label so far: its own id where it has none."""
        for name in names:
            if labels is None:
                rows = rows.withColumn(f"{name}_label", F.col(name))
            else:
                own = labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
                rows = rows.join(own, name, "left").withColumn(f"{name}_label", F.coalesce(f"{name}_label", name))
        return rows

    def likely(pairs: DataFrame) -> DataFrame:
        for c in ("x", "y"):
            pairs = pairs.join(info.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
        return pairs.filter(_similar_size(F.col("n_x"), F.col("n_y"), percent) & (agreement(F.col("bits_x"), F.col("bits_y")) >= enough)).select("x", "y")

    def take(pairs: DataFrame) -> None:
        nonlocal edges, labels
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return
        more = stored(confirmed(pairs, sets, percent), "links")
        if not more.isEmpty():
            edges = more if edges is None else edges.union(more)
            labels = components(edges)

    for turn in range(star_rounds):
        # the weightiest member of a bucket first, then any
        first = (-F.col("weight") if turn == 0 else F.lit(0)).cast("long").alias("order")
        leaders = members.groupBy("key").agg(F.min(F.struct(first, F.xxhash64("id", F.lit(turn)).alias("hash"), "id")).alias("least"))
        leaders = stored(leaders.select("key", F.col("least.id").alias("leader")), "leaders")
        pairs = members.join(leaders, "key").filter("id <> leader")
        pairs = labelled(pairs.select(F.col("id").alias("x"), F.col("leader").alias("y")).distinct(), "x", "y").filter("x_label <> y_label")
        take(likely(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()))

    rows = stored(labelled(members.select("id", "key"), "id").withColumnRenamed("id_label", "label"), "labelled")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "label"))["label"].alias("main")).filter("kinds > 1")
    mixed = stored(rows.join(stored(largest.select("key", "main"), "mixed"), "key"), "mixed")
    if mixed.isEmpty():
        return labels
    left = sets.join(mixed.select("id").distinct(), "id", "left_semi")
    mixed = stored(mixed.join(classes.select("id", "n_shingles", "bits", "bands"), "id").join(shared_sizes(left), "id"), "mixed")
    a, b = mixed.filter("label <> main").alias("a"), mixed.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label"))
    # two rows that are both outside are met twice, and once in each bucket that they share
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
    # what nobody else has is in no intersection: this bounds the similarity of every pair
    common = F.least("a.shared", "b.shared")
    reach = common * 100 >= (F.col("a.n_shingles") + F.col("b.n_shingles") - common) * percent
    near = reach & (agreement(F.col("a.bits"), F.col("b.bits")) >= enough)
    first = F.element_at(F.filter(F.zip_with("a.bands", "b.bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), 1) == F.col("a.key")
    take(a.join(b, apart & once & near & first).select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y")).distinct())
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, group and whether the document stays, for every row.

    The group tells components apart also where they have no id, or one id between them; it is
    null for documents without a set.
    """
    rows = stored(signatures(docs), "signatures")
    full = rows.filter("n_shingles > 0")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    classes = full.groupBy("shingles", "n_shingles").agg(one, F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    labels = class_components(classes, docs, percent)
    named = classes.select("id", "shingles", F.col("one.doc_id").alias("doc_id"))
    if labels is None:
        named = named.select("shingles", F.col("doc_id").alias("component_id"), F.col("id").alias("group"))
    else:
        known = named.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = known.join(least, "label").select("shingles", "component_id", F.col("label").alias("group"))
    linked = full.join(named, "shingles").select("doc_id", "text_hash", "n_shingles", "component_id", "group")
    alone = rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def components_digest(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document with its component."""
    return near_duplicates(docs, percent).drop("text_hash", "group")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each component, all columns kept; of repeated rows one stays."""
    docs, named = plainly_named(docs, "doc_id", "text")
    rows = stored(near_duplicates(docs, percent), "components")
    # documents without words are linked with nothing
    apart = F.when(F.col("n_shingles") > 0, F.lit(0)).otherwise(F.xxhash64("doc_id", "text_hash"))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    stay = rows.groupBy("group", apart.alias("a")).agg(pick).select(F.col("one.doc_id").alias("__doc"), F.col("one.text_hash").alias("__hash"))
    own = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    found = own.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__hash")), "left_semi")
    if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return named(found.drop("__own"))
    return named(found.dropDuplicates(["doc_id", "__own"]).drop("__own"))
