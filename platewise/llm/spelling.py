"""Spelling variants: frequent words one edit apart, found by asymmetric q-chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The
shorter word (of two equally long ones, either) contributes two disjoint chunks, its halves; the
other contributes its positional grams of the lengths that such chunks have. One edit leaves one
of the two chunks whole, and moves it by one place at most: so the chunk is a gram of the other
word no further than the difference of their lengths from its own place, and words that share no
such key are never met.

Many words may share a chunk (a common first half, say). Keys with more than CROWD pairs are not
joined; their words are cut again, the shared chunk put aside: what is left of a near pair is one
edit apart too, and the halves of the one's rest are looked for among the grams of the other's.
Each turn halves the rest, so that in the end words agree in all but one place and a group holds
no more words than there are letters. Nothing is dropped, and no group is expanded into all its
pairs. Every candidate is verified by its edit distance.

Words are maximal runs of Latin letters, A-Z in lower case; one of 199 occurrences, by a hash of
document and run, loses a letter, which plants variants to be found. A word's form is its near
word with the highest count, if that is at least FACTOR times its own; forms lead on to a root.

Defined results: null texts have no words; a null doc_id is empty text in the hash. Repeated rows
count again. Equal counts go to the word first in code-point order. Words of any length take part.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.scratch import stored

# Fixed values of the query.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOILT = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Pairs of a chunk's and a gram's words up to which a key is joined as it is.
CROWD = 1 << 15


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the frequent words."""
    doc_id = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    found = F.regexp_extract_all(docs["text"].cast("string"), F.lit(LETTERS), F.lit(0))
    runs = docs.select(doc_id.alias("doc"), F.explode(found).alias("run")).filter(F.length("run") >= least_length)
    # where all letters are ASCII the built-in lower case is the same, and faster
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("doc", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    at = F.crc32(F.concat(F.col("doc"), F.lit(":"), F.col("run")).cast("binary"))
    place = F.pmod(at, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(at % SPOILT == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _cut(rest: Column, start: Column | int, length: Column) -> tuple[Column, Column]:
    """A part of a text from `start` (from 0) on, and the text without it."""
    start = F.lit(start) if isinstance(start, int) else start
    part = F.substring(rest, start + 1, length)
    return part, F.concat(F.substring(rest, F.lit(1), start), F.substring(rest, start + length + 1, F.length(rest)))


def _keyed(which: int, longer: int, size: Column, part: Column, rest: Column) -> Column:
    """Key of a chunk or gram: what was put aside before, which half, the difference in length, the chunk side's length, the text."""
    return F.struct(F.xxhash64(F.col("path"), F.lit(which), F.lit(longer), size, part).alias("path"), rest.alias("rest"), F.lit(longer).alias("longer"))


def chunk_rows(words: DataFrame) -> DataFrame:
    """(word, path, rest, longer): both halves of each rest as keys, for partners as long and one longer."""
    size = F.length("rest")
    half = F.floor(size / 2).cast("int")
    first, second = _cut(F.col("rest"), 0, half), _cut(F.col("rest"), half, size - half)
    keys = [_keyed(which, longer, size, *half_of) for which, half_of in enumerate((first, second)) for longer in (0, 1)]
    keys = [F.when(F.col("longer").isNull() | (F.col("longer") == key_longer), key) for key, key_longer in zip(keys, (0, 1, 0, 1))]
    return words.select("word", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("word", "k.*")


def gram_rows(words: DataFrame) -> DataFrame:
    """(word, path, rest, longer): the positional grams that a chunk of a word as long or one shorter can equal.

    The chunk stood at 0 or at its word's half; here it stands no further on than the words
    differ in length.
    """
    keys = []
    for longer in (0, 1):
        size = F.length("rest") - longer
        half = F.floor(size / 2).cast("int")
        for which, (start, length) in enumerate(((F.lit(0), half), (half, size - half))):
            for shift in range(longer + 1):
                part, rest = _cut(F.col("rest"), start + shift, length)
                fits = (size >= 0) & (F.col("longer").isNull() | (F.col("longer") == longer))
                keys.append(F.when(fits, _keyed(which, longer, size, part, rest)))
    # equal grams at neighbouring places are one key
    return words.select("word", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("k")).select("word", "k.*")


def near_pairs(counts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): all pairs of words exactly one edit apart, each once."""
    start = counts.select("word", F.lit(0).cast("long").alias("path"), F.col("word").alias("rest"), F.lit(None).cast("int").alias("longer"))
    chunks, grams, found = start, start, None
    while True:
        chunks, grams = stored(chunk_rows(chunks), "chunks"), stored(gram_rows(grams), "grams")
        left = chunks.groupBy("path").agg(F.count("*").alias("chunks"), F.max(F.length("rest")).alias("most"))
        keys = left.join(grams.groupBy("path").agg(F.count("*").alias("grams")), "path")
        # rests of one letter cannot be cut again; their groups are bounded by the letters there are
        calm = (F.col("chunks") * F.col("grams") <= crowd) | (F.col("most") <= 1)
        keys = stored(keys.select("path", calm.alias("calm")), "keys")
        a = chunks.join(keys.filter("calm").select("path"), "path").select("path", F.col("word").alias("a"))
        b = grams.join(keys.filter("calm").select("path"), "path").select("path", F.col("word").alias("b"), "longer")
        once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
        close = (F.length("b") - F.length("a") == F.col("longer")) & (F.levenshtein("a", "b", 1) == 1)
        pairs = stored(a.join(b, "path").filter(once & close).select("a", "b").distinct(), "pairs")
        found = pairs if found is None else found.union(pairs)
        crowded = keys.filter("not calm").select("path")
        if crowded.isEmpty():
            return found.distinct()
        chunks, grams = (side.join(crowded, "path", "left_semi").select("word", "path", "rest", "longer") for side in (chunks, grams))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each turn follows twice as many forms as the last."""
    reach = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stored(step, "roots")
        reach = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return reach


def spelling_forms(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    counts = stored(word_counts(docs, least_length, least_count), "words")
    pairs = near_pairs(counts, crowd)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    near = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"))).alias("best")
    about = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = counts.join(about, "word", "left")
    is_form = -F.col("best.order") >= factor * F.col("n")
    rows = rows.select(
        "word",
        F.when(is_form, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.order")).alias("form_n"),
    )
    rows = stored(rows, "forms")
    found = rows.join(roots(rows.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
