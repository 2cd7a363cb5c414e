"""Byte-pair encoding and decoding.

Frequent words, counted over the whole corpus by a Spark job, are compiled with their ids
into a minimal acyclic transducer: states with equal remainders are one state, and each
edge adds to the number of the word that a path spells. The automaton is a file of plain
arrays which every executor maps into memory. Words that it does not hold are merged
exactly, all words of a batch in lockstep. Results equal those of the public tokenizer
file: the vocabulary, merge order and special tokens are read from it, none is built in.

Defined results: a null text is an empty one, with no ids and the digest of nothing. Each
row is encoded by itself, so repeated rows, ties, row order and other columns play no part;
an empty table gives no rows. Whole texts are encoded however long they are.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.rawtext import pieces
from platewise.llm.scratch import stored

# --- fixed values -----------------------------------------------------------
# How byte-level vocabularies split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ----------------------------------------------------------------------------

#: Words in the automaton.
LEXICON_WORDS = 50_000
#: Words longer than this many bytes stay out of the automaton.
LEXICON_BYTES = 48
#: Words that a worker remembers besides, and letters in them; it then starts anew.
REMEMBERED = 400_000
REMEMBERED_LETTERS = 16_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, n_bytes long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        model = spec["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.tokens = tokens
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64)
        self.size = size
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._made = pairs[:, 2]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.split = regex.compile(PATTERN).findall
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    NO_RANK = np.int64(1) << 40

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], self.NO_RANK)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact ids of each word: the lowest-ranked pair is merged, the leftmost first, until none is left.

        All words advance together. A row of the table is a word; what is merged away closes up.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order] // 8)) + 1):
            if len(part) and lengths[part[-1]] > 256:
                for i in part:
                    out[i] = self._merged_alone(words[i])
                continue
            for i in range(0, len(part), 1 << 14):
                self._lockstep([words[k] for k in part[i : i + (1 << 14)]], part[i : i + (1 << 14)], out)
        return out

    def _lockstep(self, words: list[bytes], numbers: np.ndarray, out: list[np.ndarray]) -> None:
        count = np.fromiter(map(len, words), np.int64, len(words))
        width = int(count.max(initial=0))
        if not width:
            return
        ids = np.zeros((len(words), width + 1), np.int64)
        ids[np.arange(width + 1) < count[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        inner = np.arange(width) < (count - 1)[:, None]
        ranks = np.full((len(words), width), self.NO_RANK)
        ranks[inner] = self.ranks(ids[:, :-1][inner], ids[:, 1:][inner])
        alive = np.arange(len(words))
        while len(alive):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(alive))
            best = ranks[rows, at]
            going = best < self.NO_RANK
            if not going.all():
                for k in np.flatnonzero(~going):
                    out[numbers[alive[k]]] = ids[k, : count[k]].copy()
                alive, ids, ranks, count, at, best = (x[going] for x in (alive, ids, ranks, count, at, best))
                rows = np.arange(len(alive))
                if not len(alive):
                    break
            # close the gap after the merged pair
            shift = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            merged = np.take_along_axis(ids, np.minimum(shift, width), axis=1)
            merged[rows, at] = self._made[best]
            ids[:, :-1] = merged
            ranks = np.take_along_axis(ranks, np.minimum(shift, width - 1), axis=1)
            count = count - 1
            ranks[rows, count - 1] = self.NO_RANK
            has = at + 1 < count
            ranks[rows[has], at[has]] = self.ranks(ids[rows[has], at[has]], ids[rows[has], at[has] + 1])
            ranks[rows[~has], at[~has]] = self.NO_RANK
            has = at > 0
            ranks[rows[has], at[has] - 1] = self.ranks(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
            width = int(count.max())
            ids, ranks = ids[:, : width + 1], ranks[:, :width]

    def _merged_alone(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of pairs over a linked list, so time stays near linear."""
        import heapq

        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        size = len(ids)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < self.NO_RANK]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < size:
                pair = ids[i], ids[j]
                if pair not in known:
                    known[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] < self.NO_RANK:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue
            ids[i], ids[j] = int(self._made[rank]), -1
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


def compiled(entries: dict[bytes, np.ndarray]) -> bytes:
    """The minimal acyclic transducer of the words, as one block of arrays.

    Built from the sorted words: whenever a branch ends, its states are looked up among the
    finished ones and shared when they agree. An edge's number counts the words that branch
    off before it, so a path sums to the place of its word in the sorted list, where the ids are.
    """
    finished: dict[tuple, int] = {}
    states: list[tuple] = []  # (accepting, edges)

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in finished:
            finished[key] = len(states)
            states.append(key)
        return finished[key]

    path: list[list] = [[False, []]]
    previous = b""
    in_order = sorted(entries)
    for word in in_order:
        common = 0
        for a, b in zip(word, previous):
            if a != b:
                break
            common += 1
        for depth in range(len(previous), common, -1):
            path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        previous = word
    for depth in range(len(previous), 0, -1):
        path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
    root = freeze(path[0])

    below = np.zeros(len(states), np.int64)
    for i, (accepting, edges) in enumerate(states):  # a state's targets are finished before it
        below[i] = accepting + sum(int(below[t]) for _, t in edges)
    keys, targets, numbers = [], [], []
    for i, (accepting, edges) in enumerate(states):
        passed = int(accepting)
        for label, target in edges:
            keys.append(i << 8 | label)
            targets.append(target)
            numbers.append(passed)
            passed += int(below[target])
    counts = [len(entries[w]) for w in in_order]
    parts = [
        np.array(keys, np.int64),
        np.array(targets, np.int64),
        np.array(numbers, np.int64),
        np.array([a for a, _ in states], np.int64),
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        np.concatenate([*(entries[w] for w in in_order), np.zeros(0)]).astype(np.int64),
    ]
    head = np.array([root, *map(len, parts)], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """Looks words up in the mapped automaton, a whole batch of them letter by letter."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            block = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        self.root, sizes = int(block[0]), block[1:7]
        ends = 7 + np.cumsum(sizes)
        self.keys, self.targets, self.numbers, self.accepting, self.starts, self.ids = (block[e - s : e] for s, e in zip(sizes, ends))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the lexicon's words, or -1."""
        found = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(self.keys) or not len(words):
            return found
        going = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_BYTES))
        text = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.cumsum(lengths) - lengths
        state, number = np.full(len(going), self.root, np.int64), np.zeros(len(going), np.int64)
        for depth in range(LEXICON_BYTES):
            if not len(going):
                break
            key = state << 8 | text[offsets[going] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            going, at, number = going[ok], at[ok], number[ok]
            state, number = self.targets[at], number + self.numbers[at]
            over = lengths[going] == depth + 1
            done = over & (self.accepting[state] == 1)
            found[going[done]] = number[done]
            going, state, number = going[~over], state[~over], number[~over]
        return found


class Encoder:
    """Ids of whole texts. Holds what a worker has learned about words so far."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, np.ndarray] = {}
        self.letters = 0

    def _full(self) -> bool:
        return len(self.known) > REMEMBERED or self.letters > REMEMBERED_LETTERS

    def _learn(self, chunks: set[str]) -> None:
        split = {c: self.vocabulary.split(c) for c in chunks}
        words = list({w for parts in split.values() for w in parts})
        raw = [w.encode() for w in words]
        places = self.lexicon.places(raw) if self.lexicon else np.full(len(raw), -1)
        ids: dict[str, np.ndarray] = {}
        unseen = np.flatnonzero(places < 0)
        for k, made in zip(unseen, self.vocabulary.merged([raw[k] for k in unseen])):
            ids[words[k]] = made.astype(np.uint32)
        for k in np.flatnonzero(places >= 0):
            ids[words[k]] = self.lexicon.ids[self.lexicon.starts[places[k]] : self.lexicon.starts[places[k] + 1]].astype(np.uint32)
        if self._full():
            self.known.clear()
            self.letters = 0
        for chunk, parts in split.items():
            self.letters += len(chunk)
            self.known[chunk] = ids[parts[0]] if len(parts) == 1 else np.concatenate([ids[p] for p in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        around, special = self.vocabulary.around, self.vocabulary.special
        cut: list[list[str]] = []
        for text in texts:
            if around and any(s in text for s in special):
                cut.append([c for part in around.split(text) for c in ([part] if part in special else chunks_of(part))])
            else:
                cut.append(chunks_of(text))
        needed = set().union(*cut) if cut else set()
        if self.known.keys() & special.keys() != special.keys():
            self.known.update({s: np.array([i], np.uint32) for s, i in special.items()})
        missing = needed - self.known.keys()
        if missing:
            before = {c: self.known[c] for c in needed - missing} if self._full() else {}
            self._learn(missing - special.keys())
            self.known.update(before)
            self.letters += sum(map(len, before))
            self.known.update({s: np.array([i], np.uint32) for s, i in special.items()})
        known = self.known
        return [np.concatenate([known[c] for c in chunks]) if chunks else np.zeros(0, np.uint32) for chunks in cut]


_ODD = re.compile(r" (?:\s|\Z)")
_TOGETHER = re.compile(r"(?:[^ ]| (?=\s|\Z))+| (?:[^ ]| (?=\s|\Z))*")


def chunks_of(text: str) -> list[str]:
    """The text cut before every blank that a visible character follows.

    The split pattern always begins a word there, so each chunk splits as it does in the text.
    """
    if not text:
        return []
    if _ODD.search(text):
        return _TOGETHER.findall(text)
    parts = text.split(" ")
    out = [" " + p for p in parts]
    out[0] = parts[0]
    return out if parts[0] else out[1:]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, lexicon: str = "") -> Encoder:
    """This worker's encoder. Both names are files that Spark has brought to the executor, or local paths."""
    key = vocabulary, lexicon
    if key not in _encoders:
        path = lambda name: name if os.path.isabs(name) else SparkFiles.get(name)
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(path(vocabulary)), Lexicon(path(lexicon)) if lexicon else None)
    return _encoders[key]


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that no more than `most` rows reach, from the histogram of the column n.

    As few counts as there can be different ones go to the driver: the root of the corpus's words.
    """
    rows, least = 0, 1 << 62
    for row in sorted(counts.groupBy("n").agg(F.count("*").alias("rows")).collect(), key=lambda row: -row["n"]):
        rows += row["rows"]
        if rows > most:
            break
        least = row["n"]
    return least


def frequent_words(docs: DataFrame, count: int = LEXICON_WORDS) -> list[str]:
    """The most frequent blank-separated words of all documents, with their leading blank.

    At most `count`, found by a threshold of frequency: of words that are equally frequent, all
    or none. Words that occur once are left out.
    """
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), " ")).alias("word"))
    words = words.filter((F.length("word") > 0) & (F.octet_length("word") < LEXICON_BYTES))
    counts = stored(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"), "words")
    top = counts.filter(F.col("n") >= least_count(counts, count)).select("word")
    return sorted(" " + row.word for row in top.collect())


def lexicon_file(docs: DataFrame, vocabulary: str, count: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words and hands the file to every executor; returns its name.

    Its size is bounded by `count` words of `LEXICON_BYTES` bytes, whatever the corpus.
    """
    model = Vocabulary(vocabulary)
    words = {w.encode() for chunk in frequent_words(docs, count) for w in model.split(chunk)}
    words = sorted(w for w in words if len(w) <= LEXICON_BYTES)
    block = compiled(dict(zip(words, model.merged(words))))
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as file:
        file.write(block)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encoded(docs: DataFrame, vocabulary: str, lexicon: str) -> DataFrame:
    """doc_id and the ids of every document as an array, for further operators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids = encoder(vocabulary, lexicon).encode(piece.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> DataFrame:
    """Encodes every document, decodes the ids, and gives the digests of both."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    lexicon = lexicon_file(docs, vocabulary, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = piece.column("text").fill_null("").to_pylist()
            model = encoder(vocabulary, lexicon)
            counts, codes, plain, same, sizes = [], [], [], [], []
            for text, ids in zip(texts, model.encode(texts)):
                back = model.vocabulary.decoded(ids).decode("utf-8", "replace").encode()
                counts.append(len(ids))
                codes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                plain.append(hashlib.sha256(back).hexdigest())
                same.append(back == text.encode())
                sizes.append(len(back))
            arrays = [pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(plain, pa.string()), pa.array(same, pa.bool_()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "n_bytes"])

    return docs.mapInArrow(run, SCHEMA)
