"""The language predictions and the quality classifier against versions in plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from platewise.llm import language_id, weak_labels


# --- languages


def plain_languages(rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    runs = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    words, grams = collections.Counter(), collections.Counter()
    for i, text, lang in rows:
        if lang is not None and not held(i):
            for run in runs(text):
                words[run, lang] += 1
                marked = f"^{run}$"
                for start in range(len(marked)):
                    for n in range(1, min(5, len(marked) - start) + 1):
                        grams[marked[start : start + n], lang] += 1
    languages = sorted({lang for _, lang in words})

    def table(counts, keys):
        total = {lang: sum(counts[k, lang] + 0.5 for k in keys) for lang in languages}
        return {k: [math.log((counts[k, lang] + 0.5) / total[lang]) for lang in languages] for k in keys}

    known = table(words, {w for w, _ in words})
    by_size = {n: table(grams, {g for g, _ in grams if len(g) == n}) for n in range(1, 6)}

    def score(word):
        if word in known:
            return known[word]
        marked = f"^{word}$"
        for n in range(min(5, len(marked)), 0, -1):
            found = [by_size[n][g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in by_size[n]]
            if found:
                return [sum(column) / len(found) for column in zip(*found)]
        return [0.0] * len(languages)

    out = []
    for i, text, _ in rows:
        total = [sum(column) for column in zip(*map(score, runs(text)))]
        if not total:
            out.append((i, held(i), "und", 0.0))
        else:
            odds = [math.exp(t - max(total)) for t in total]
            best = odds.index(max(odds))
            out.append((i, held(i), languages[best], odds[best] / sum(odds)))
    return out


def test_language_predictions_equal_the_plain_version(documents):
    rng = random.Random(21)
    alphabets = {"aa": "abcdeé", "bb": "cdefgh", "cc": "ghijka"}
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40)] for lang, letters in alphabets.items()}
    rows = []
    for i in range(150):
        lang = rng.choice(sorted(stock))
        fresh = lambda: "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 9)))  # noqa: B023, E731
        rows.append((i, " ".join(rng.choice(stock[lang]).title() if rng.random() < 0.7 else fresh() for _ in range(rng.randint(0, 6))), lang if i % 7 else None))
    rows += [(None, "abc deé", "aa"), (900, "qq zz", None), (901, "1 2", "bb"), (902, None, "cc"), (3, *rows[3][1:])]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got = sorted([tuple(r)[:4] for r in language_id.identified(documents(*rows)).select("doc_id", "held_out", "lang_pred", "score").collect()], key=key)
    want = sorted(plain_languages(rows), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)


# --- quality


def plain_posterior(calls, rounds=50):
    accuracy, prior = [0.8] * len(calls[0]), 0.3
    for _ in range(rounds):
        bad = []
        for row in calls:
            odds = math.log(prior / (1 - prior)) + sum((1 if c else -1) * math.log(a / (1 - a)) for c, a in zip(row, accuracy) if c >= 0)
            bad.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        for k in range(len(accuracy)):
            spoken = [(row[k], p) for row, p in zip(calls, bad) if row[k] >= 0]
            accuracy[k] = max(0.05, min(0.99, (sum(p if c else 1 - p for c, p in spoken) + 0.8) / (len(spoken) + 1)))
        prior = max(0.01, min(0.99, sum(bad) / len(bad)))
    return bad, accuracy


def plain_scorer(sets, bad, rounds):
    documents, in_bad = collections.Counter(), collections.Counter()
    for own, p in zip(sets, bad):
        for f in own:
            documents[f] += 1
            in_bad[f] += p
    share = max(0.01, min(0.99, sum(bad) / len(bad)))
    use = {f for f, n in documents.items() if f[0] == "share" or abs(in_bad[f] - n * share) >= 5 * math.sqrt(n * share * (1 - share))}
    weights, square = dict.fromkeys(use, 0.0), dict.fromkeys(use, 1e-6)
    bias, bias_square = math.log(share / (1 - share)), 1e-6
    for _ in range(rounds):
        error = [1 / (1 + math.exp(-max(-30, min(30, bias + sum(weights[f] for f in own & use))))) - p for own, p in zip(sets, bad)]
        slope = {f: 0.02 * w for f, w in weights.items()}
        for own, e in zip(sets, error):
            for f in own & use:
                slope[f] += e
        for f, s in slope.items():
            square[f] += s * s
            weights[f] -= 0.2 * s / math.sqrt(square[f])
        bias_square += sum(error) ** 2
        bias -= 0.2 * sum(error) / math.sqrt(bias_square)
    return weights, bias


def plain_shares(text):
    words = text.split()
    n = max(1, len(words))
    letters = sum(c.isascii() and c.isalpha() for c in text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [math.exp(-len(words) / 100), min(1, sum(c in "#*$%&|<>" for c in text) / n), sum(c.isupper() for c in text) / max(1, letters),
            min(1, text.count("!") / n), sum(c.isdigit() for c in text) / max(1, len(text)), len(repeated) / n, 0.0, 1 - math.exp(-sum(map(len, words)) / n / 10)]


def plain_features(text):
    own = {("share", i, min(15, int(s * 16))) for i, s in enumerate(plain_shares(text))}
    for word in re.findall("[a-z]+", text.lower()):
        own |= {("word", 0, word)} | {("word", n, word[:n]) for n in (4, 5, 6) if len(word) > n}
    return own


def plain_verdicts(rows, labels, rounds):
    given = {}
    for i, quality, toxic in labels:
        if i is not None and (quality is not None or toxic is not None):
            given[i] = max(given.get(i, 0), int(quality == 0 or toxic == 1))
    sample = [(text, given[i]) for i, text in rows if i in given and text is not None]
    calls = [[1 if s >= c else -1 for s, c in zip(plain_shares(t), weak_labels.CALLS.values())] + [-1, label] for t, label in sample]
    weights, bias = plain_scorer([plain_features(t) for t, _ in sample], plain_posterior(calls)[0], rounds)
    out = []
    for i, text in rows:
        lettered = any(c.isalpha() for c in text or "")
        margin = bias + sum(weights.get(f, 0.0) for f in plain_features(text or ""))
        out.append((i, 1 / (1 + math.exp(max(-30, min(30, margin)))) if lettered else 0.0))
    return out


def test_posterior_equals_the_plain_version():
    rng = random.Random(3)
    calls = [[rng.choice((-1, 0, 1)), rng.choice((-1, -1, 1)), 1 if rng.random() < 0.3 else -1] for _ in range(200)]
    got, accuracy = weak_labels.posterior(np.array(calls))
    want, plain = plain_posterior(calls)
    assert got == pytest.approx(want, abs=1e-9) and accuracy == pytest.approx(plain, abs=1e-9)


def test_heuristics_move_the_posterior():
    """A labeller that agrees with the others where they overlap decides where they are silent."""
    rng = random.Random(5)
    truth = [rng.random() < 0.4 for _ in range(600)]
    call = lambda t, right: int(t if rng.random() < right else not t)
    calls = [[call(t, 0.95), call(t, 0.9), -1 if i < 300 else call(t, 0.9)] for i, t in enumerate(truth)]
    alone = [[-1, c[1], c[2]] if i < 300 else c for i, c in enumerate(calls)]
    bad, accuracy = weak_labels.posterior(np.array(alone))
    assert np.mean([(p > 0.5) == bool(c[1]) for p, c in zip(bad[:300], alone)]) == 1.0 and accuracy[1] > 0.8


def test_verdicts_equal_the_plain_version(spark, documents, monkeypatch):
    monkeypatch.setattr(weak_labels, "ROUNDS", 60)
    monkeypatch.setattr(weak_labels.trained, "__defaults__", (60,))
    rng = random.Random(17)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(stock) for _ in range(rng.randint(5, 60))]
        if i % 3 == 1:
            words = [w.upper() + "!" * (i % 2) for w in words] + ["bargain"] * 2
        if i % 5 == 2:
            words += ["zorgvile", "quux"]
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(i % 3 != 1), int(i % 5 == 2)))
    rows += [(500, None), (501, ""), (502, "12 !! 3"), (None, rows[1][1]), (1, rows[1][1])]
    labels += [(7, 0, None), (None, 0, 1), (8, None, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted([(r.doc_id, r.quality, r.kept) for r in weak_labels.quality_verdicts(documents(*rows), known, size=10_000).collect()], key=key)
    want = sorted(plain_verdicts(rows, labels, 60), key=key)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)
    assert all(g[2] == (w[1] > 0.5) for g, w in zip(got, want) if abs(w[1] - 0.5) > 1e-3)
