"""Language identification, words first.

Learned: how often each word, and each character n-gram of the words, occurs per language,
counted by Spark jobs over all training documents. The model keeps a bounded number of words
and n-grams, however large the corpus: as many of the most frequent ones of each language, so
that a large language displaces none of a small one, and where these leave room, because
languages share some or have few, the most frequent ones of all. A word that the model knows is
scored by its log frequency per language; an unknown one by its longest n-grams of which the
model knows any, then by shorter ones, down to single letters. A run of more than WORD_CHARS
letters, as in a script without spaces, is never looked up whole: its n-grams are counted
like all others, and it is scored in parts of about that length, each like an unknown word.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text if nothing could be learned. Languages that score alike give way to the first by name.
A document without an id counts as held out. Only text and language of training rows are
read, so other columns play no part; repeated rows count again in training and are predicted
alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.rawtext import pieces
from platewise.llm.scratch import Sent, stored

UNKNOWN = "und"
#: Words and n-grams that the model keeps.
MODEL_WORDS = 100_000
MODEL_GRAMS = 200_000
LONGEST_GRAM = 5
#: Longer runs of letters are not words; only their n-grams count.
WORD_CHARS = 40
#: Places of a longer run that are counted together.
RUN_CHARS = 64
#: Words that a worker remembers; it then starts anew. WORD_CHARS times as many letters at most.
REMEMBERED = 400_000
#: Added to every count.
SMOOTHING = 0.5

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTERS = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    """Log frequencies per language of words and n-grams.

    `words` and `grams` are keys and their counts, a row per key and a column per language.
    """

    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray]):
        self.languages = languages
        self.words = self._table(*words)
        self.grams = []
        for n in range(1, LONGEST_GRAM + 1):
            at = [i for i, key in enumerate(grams[0]) if len(key) == n]
            self.grams.append(self._table([grams[0][i] for i in at], grams[1][at]))
        self._forget()

    def _forget(self) -> None:
        """Words scored so far: their rows in `scores`."""
        self.known: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((1024, len(self.languages)))

    @staticmethod
    def _table(keys: list[str], counts: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        counts = counts + SMOOTHING
        return {key: row for row, key in enumerate(keys)}, np.log(counts / np.maximum(counts.sum(axis=0), 1e-9))

    def word(self, word: str) -> np.ndarray:
        """One score per language."""
        rows, table = self.words
        at = rows.get(word)
        if at is not None:
            return table[at]
        marked = f"^{word}$"
        if len(word) <= WORD_CHARS:
            return self._by_grams(marked, 0, len(marked))
        # a longer run says as much as several words; its parts are about alike in length
        parts = -(-len(marked) // (WORD_CHARS + 2))
        cuts = [len(marked) * i // parts for i in range(parts + 1)]
        return sum(self._by_grams(marked, start, stop) for start, stop in zip(cuts, cuts[1:]))

    def _by_grams(self, marked: str, start: int, stop: int) -> np.ndarray:
        """Scores by the n-grams that begin in a part."""
        for n in range(min(LONGEST_GRAM, len(marked)), 0, -1):
            rows, table = self.grams[n - 1]
            found = [rows[g] for g in (marked[i : i + n] for i in range(start, min(stop, len(marked) - n + 1))) if g in rows]
            if found:
                return np.add.reduce(table.take(found, axis=0)) / len(found)
        return np.zeros(len(self.languages))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = [_LETTERS(text.lower()) for text in texts]
        if len(self.known) > REMEMBERED or self.letters > REMEMBERED * WORD_CHARS:
            self._forget()
        for word in set().union(*found) - self.known.keys():
            row = self.known[word] = len(self.known)
            if row == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[row] = self.word(word)
            self.letters += len(word)
        out = []
        for words, text in zip(found, texts):
            if not words or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def least_counts(rows: DataFrame, limits: dict[str, int]) -> dict[str, int]:
    """Per column, a positive count that the `limit` largest values reach, and besides them only values equal to the least of these.

    It comes from a histogram, so that a sort of what reaches it takes few rows more than the limit, not some of each task.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("of"), F.col(name).cast("long").alias("n")) for name in limits])
    sizes = rows.select(F.inline(cells)).filter("n > 0").groupBy("of", "n").agg(F.count("*").alias("rows")).collect()
    left, least = dict(limits), dict.fromkeys(limits, 1 << 62)
    for row in sorted(sizes, key=lambda row: -row["n"]):
        if left[row["of"]] > 0:
            least[row["of"]] = row["n"]
        left[row["of"]] -= row["rows"]
    return least


def learned(docs: DataFrame, words: int = MODEL_WORDS, grams: int = MODEL_GRAMS) -> Model:
    """Counts words and n-grams of all documents with a language."""
    text = F.lower(F.col("text").cast("string"))
    found = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.explode(F.split(text, r"\P{L}+")).alias("word"))
    # a long run is counted in parts that overlap, so each of its places begins one longest n-gram
    mark = F.concat(F.lit("^"), F.col("word"), F.lit("$" * LONGEST_GRAM))
    overlapping = F.regexp_extract_all(mark, F.lit(f"(?=(.{{1,{RUN_CHARS + LONGEST_GRAM - 1}}})).{{1,{RUN_CHARS}}}"), F.lit(1))
    whole = F.length("word") <= WORD_CHARS
    found = found.filter(F.length("word") > 0)
    found = found.select("lang", whole.alias("whole"), F.explode(F.when(whole, F.array("word")).otherwise(overlapping)).alias("word"))
    counts = stored(found.groupBy("word", "lang", "whole").agg(F.count("*").alias("n")), "words")
    # one longest n-gram from every place of a word, filled up behind its end; the shorter
    # ones are the beginnings of these, and are taken from their counts
    marked = F.when(F.col("whole"), mark).otherwise(F.col("word"))
    # the last part of a run may hold nothing but what fills it up
    places = F.when(F.length(marked) >= LONGEST_GRAM, F.sequence(F.lit(1), F.length(marked) - (LONGEST_GRAM - 1)))
    cuts = F.transform(places, lambda i: F.substring(marked, i, F.lit(LONGEST_GRAM)))
    longest = counts.select("lang", "n", F.explode(cuts).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    end = F.locate("$", "gram")
    size = F.when(end == 0, LONGEST_GRAM).otherwise(end)
    pieces_of = longest.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("gram", F.lit(1), i))).alias("word"))

    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())

    def top(rows: DataFrame, limit: int) -> tuple[list[str], np.ndarray]:
        """Fetched as columns: one for the keys, one per language."""
        if not languages:
            return [], np.zeros((0, 0))
        own = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
        keys = stored(rows.groupBy("word").agg(F.sum("n").alias("total"), *own), "keys")
        share = limit // len(languages)
        least = least_counts(keys, {"total": limit} | {f"n{i}": share for i in range(len(languages))})
        some = keys.filter(F.col("total") >= least["total"]).orderBy(F.desc("total"), "word").limit(limit).withColumn("spare", F.lit(True))
        for i in range(len(languages)):
            most = keys.filter(F.col(f"n{i}") >= least[f"n{i}"]).orderBy(F.desc(f"n{i}"), "word").limit(share)
            some = some.union(most.withColumn("spare", F.lit(False)))
        best = some.groupBy(*keys.columns).agg(F.bool_and("spare").alias("spare")).orderBy("spare", F.desc("total"), "word").limit(limit)
        found = best.drop("total", "spare").toArrow()
        return found.column("word").to_pylist(), np.stack([found.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1).astype(float)

    return Model(languages, top(counts.filter("whole"), words), top(pieces_of, grams))


def identified(docs: DataFrame, **sizes) -> DataFrame:
    """One row per document: held out or not, predicted language and its probability."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = Sent(docs.sparkSession, learned(docs.filter(~F.col("held_out")), **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            languages, scores = zip(*model.get().predict(part.column("text").fill_null("").to_pylist()))
            arrays = [part.column("doc_id"), part.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, SCHEMA)
