"""Quality rules by repetition coverage.

Words are runs of bytes other than blank, tab, LF, VT, FF, CR. Rolling hashes of n-grams of
several lengths, in numpy over whole texts, tell which word n-grams and lines a text holds
more than once; a rule measures the share of the text's word characters inside them. One
more rule, from the same published set, limits symbols per word.

Defined results: a null text is an empty one and fails the base rules (no words). A repeated
row is judged twice, alike. A text's columns depend on that text alone, so ties, row order
and other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from platewise.llm.rawtext import U, Prefixes, joined, lines, mix, per_text, pieces, words

# --- fixed values -----------------------------------------------------------
# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
# Published limits on the share of characters: in the most frequent n-gram of 2 to 4
# words, in repeated n-grams of 5 to 10 words, and in repeated lines.
TOP_SHARES = {2: 0.20, 3: 0.18, 4: 0.16}
REPEATED_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20
# Published limit on symbols per word.
SYMBOLS_PER_WORD = 0.1
# ----------------------------------------------------------------------------

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_share double, top_share double, repeated_share double, failed_rules string"
)


@dataclass(frozen=True)
class Limits:
    """min_words, repeat_percent: the base rules. The shares are limits of the coverage rules."""

    min_words: int = 50
    repeat_percent: int = 50
    line_share: float = LINE_SHARE
    symbols_per_word: float = SYMBOLS_PER_WORD
    top_shares: dict = field(default_factory=lambda: dict(TOP_SHARES))
    repeated_shares: dict = field(default_factory=lambda: dict(REPEATED_SHARES))


def _keyed(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(texts.astype(np.uint64) + U(1)))


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key occurs, and whether it stood earlier."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(head) - 1
    size = np.bincount(group, minlength=1)
    count, earlier = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    count[order] = size[group]
    earlier[order] = ~head
    return count, earlier


def _grams(word_hashes: np.ndarray, word_texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside one text, and the first word of each."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(word_hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total = total * U(0x9E3779B97F4A7C15) + word_hashes[i : i + size]
    first = np.flatnonzero(word_texts[:size] == word_texts[n - 1 :])
    return _keyed(total[first], word_texts[first]), first


def _covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """All columns but doc_id, for whole texts."""
    data, starts, ends = joined(texts)
    docs = len(starts)
    prefixes = Prefixes(data)
    first, last, text = words(data, starts, ends)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[last] - points[first]
    n_words = per_text(text, docs)
    word_chars = per_text(text, docs, chars)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    at = np.concatenate([[0], np.cumsum(symbol[data])])
    n_symbols = at[ends] - at[starts]

    line_start, line_end, line_text = lines(data, starts, ends)
    full = np.searchsorted(first, line_start) < np.searchsorted(first, line_end)
    line_start, line_end, line_text = line_start[full], line_end[full], line_text[full]
    _, again = _counts(_keyed(prefixes.of(line_start, line_end) ^ mix((line_end - line_start).astype(np.uint64)), line_text))
    n_dup_lines = per_text(line_text[again], docs)
    chars_before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = chars_before[np.searchsorted(first, line_end)] - chars_before[np.searchsorted(first, line_start)]
    dup_line_chars = per_text(line_text[again], docs, line_chars[again])

    hashes = mix(prefixes.of(first, last) ^ mix((last - first).astype(np.uint64)))
    keys, window = _grams(hashes, text, 3)
    count, _ = _counts(keys)
    in_repeat = _covered(window[count >= 2], 3, len(first))
    n_repeat_words = per_text(text[in_repeat], docs)

    whole = np.maximum(word_chars, 1)
    line_share = dup_line_chars / whole
    failed = {"lines": line_share > limits.line_share, "symbols": n_symbols > limits.symbols_per_word * n_words}
    top_share, repeated_share = np.zeros(docs), np.zeros(docs)
    for n, limit in limits.top_shares.items():
        keys, window = _grams(hashes, text, n)
        count, _ = _counts(keys)
        gram_chars = chars_before[window + n] - chars_before[window]
        most = np.zeros(docs, np.int64)
        repeated = count >= 2
        np.maximum.at(most, text[window[repeated]], (count * gram_chars)[repeated])
        # windows of one n-gram may overlap: no share is above the whole
        share = np.minimum(most / whole, 1.0)
        top_share = np.maximum(top_share, share)
        failed[f"top_{n}"] = share > limit
    for n, limit in limits.repeated_shares.items():
        keys, window = _grams(hashes, text, n)
        count, _ = _counts(keys)
        covered = _covered(window[count >= 2], n, len(first))
        share = per_text(text[covered], docs, chars[covered]) / whole
        repeated_share = np.maximum(repeated_share, share)
        failed[f"repeated_{n}"] = share > limit

    base_failed = (n_words < limits.min_words) | (100 * n_repeat_words > limits.repeat_percent * n_words)
    names = list(failed)
    table = np.stack([failed[name] for name in names], axis=1) if docs else np.zeros((0, len(names)), bool)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": base_failed,
        "kept": ~base_failed & ~table.any(axis=1),
        "line_share": line_share,
        "top_share": top_share,
        "repeated_share": repeated_share,
        "failed_rules": np.array([",".join(n for n, hit in zip(names, row) if hit) for row in table], object),
    }


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with its counts, shares, failed rules and verdict."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            columns = measures(piece.column("text"), limits)
            arrays = [piece.column("doc_id"), *(pa.array(values) for values in columns.values())]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(judged, SCHEMA)
