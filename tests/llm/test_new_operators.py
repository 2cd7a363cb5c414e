"""Whitening, spelling variants and SimHash groups against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from platewise.llm import catalog, simhash, spelling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- whitening


def spectra():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    low = rng.standard_normal((30, 6))
    yield "spread", np.cov(rng.standard_normal((900, 150)) * np.linspace(1, 4, 150), rowvar=False)
    yield "flat", np.cov(rng.standard_normal((900, 90)), rowvar=False)
    yield "equal", turn @ np.diag([7.0] * 10 + [3.0] * 20 + [1.0] * 18) @ turn.T
    yield "rank six", low @ low.T
    yield "tiny beside large", turn @ np.diag(10.0 ** -np.arange(48.0) / 4) @ turn.T
    yield "diagonal", np.diag(np.arange(1.0, 41.0))
    yield "three wide", np.diag([4.0, 2.0, 1.0])


@pytest.mark.parametrize("name, matrix", list(spectra()), ids=lambda v: v if isinstance(v, str) else "")
def test_leading_pairs_reach_double_precision(name, matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_pairs(lambda block: matrix @ block, len(matrix), 16)
    true = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert len(values) == min(16, len(matrix))
    assert np.abs(values - true).max() <= 1e-13 * true[0]
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def test_minres_solves_each_column():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    shifts, right = np.array([0.0, 1.5, -2.0]), rng.standard_normal((20, 3))
    right[:, 2] = 0
    x = whitening.minres(lambda block: a @ block - block * shifts, right, 60)
    assert np.abs(a @ x - x * shifts - right).max() < 1e-8 and not x[:, 2].any()


def plain_whitening(rows):
    kept = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    whole = [(i, [int(np.floor(64 * c)) + 1000000 for c in v] + [1000000] * (width - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(x) for _, x in whole}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(covariance))
    out = {}
    for i, x in whole:
        d = np.array(x, dtype=object) * n - sums
        for c in range(min(16, width)):
            if values[c] > 1e-10 * values[0]:
                out.setdefault((i, c + 1), []).append((n, sum(int(v) ** 2 for v in d), (d / n).astype(float) @ axes[:, c] / np.sqrt(values[c]), values[c] / np.trace(covariance)))
    return out


VECTORS = "vec_id long, embedding array<float>, x int, total string, n long"


def whitened_as_plain(spark, rows):
    frame = spark.createDataFrame([(i, v, 7, "t", 1) for i, v in rows], VECTORS).repartition(3)
    want, got = plain_whitening(rows), collections.defaultdict(list)
    signs = {}
    for r in sorted(whitening.whitened(frame).collect(), key=lambda r: (r.component, -abs(r.whitened))):
        got[r.vec_id, r.component].append(r)
        assert r.identity_error < 1e-9
    assert got.keys() == want.keys()
    for (i, c), found in got.items():
        for r, (n, deviation, value, explained) in zip(sorted(found, key=lambda r: (r.deviation, abs(r.whitened))), sorted(want[i, c], key=lambda w: (w[1], abs(w[2])))):
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(value), rel=1e-7, abs=1e-8)
            if abs(value) > 1e-3:
                assert signs.setdefault(c, np.sign(r.whitened * value)) == np.sign(r.whitened * value)


def test_whitening_equals_the_plain_version(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(20) * np.linspace(0.2, 1, 20)).astype(np.float32).tolist()) for i in range(300)]
    odd = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (None, rows[3][1]), (904, [0.5, -0.5]), (905, [])]
    # a third of all rows is one vector, which counts once
    whitened_as_plain(spark, rows + odd + [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1])])


def test_whitening_of_little(spark):
    def of(*rows):
        return whitening.whitened(spark.createDataFrame([(i, v, 1, "", 1) for i, v in rows], VECTORS))

    assert of().collect() == [] and of((1, [1.0, 2.0]), (2, [1.0, 2.0])).collect() == [] and of((1, []), (2, None)).collect() == []
    two = of((1, [0.0, 1.0]), (2, [0.0, 3.0])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in two) == [(1, 1, 2, 128**2, -1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0)]
    large = of((1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])).collect()
    # the third lies at the mean of the first entry and 64 from that of the second
    assert {r.vec_id: r.deviation for r in large} == {1: None, 2: None, 3: 128**2}


# --- spelling


def plain_forms(rows, least_length=6, least_count=5, factor=5):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            hashed = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if hashed % 199 == 0:
                word = word[: hashed % len(word)] + word[hashed % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in others.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= factor * counts[w]}
    out = []
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, form.get(word), root, n, len(others[word]), counts[form[word]] if word in form else None))
    return sorted(out, key=repr)


FORMS = ("word", "form", "root", "n", "n_near", "form_n")


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[: max(i - 1, 0)] + word[i:], word[: max(i - 1, 0)] + rng.choice(letters) + word[i:]])


@pytest.mark.parametrize("crowd", [0, 6, spelling.CROWD])
def test_forms_equal_brute_force(documents, collected, crowd):
    rng = random.Random(4)
    letters = "abÉÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(25)]
    words = [(w, rng.choice([5, 6, 30, 200])) for w in base]
    words += [(edited(rng, w, letters), rng.choice([4, 5, 40])) for w in base for _ in range(6)]
    words += [("prefix" + x + y, 5) for x in "abcde" for y in "abcd"] + [("z" * k, 5 * 6**k % 4001) for k in range(5, 11)]
    tokens = [w for w, n in words for _ in range(n)]
    rng.shuffle(tokens)
    rows = [(i, rng.choice([" ", "-", "1", "\n日"]).join(tokens[i::90])) for i in range(90)]
    rows += [(None, "Prefixaa PREFIXAA prefixaa"), (3, None), (4, ""), (5, "123 456"), (6, rows[6][1]), (7, "long" * 5000 + " ")] * 2
    assert collected(spelling.spelling_forms(documents(*rows), crowd=crowd), *FORMS) == plain_forms(rows)


def test_crowded_halves_are_not_expanded_into_pairs(spark, monkeypatch):
    # 4,000 words that share their first half, and few that are near each other
    rng = random.Random(3)
    words = {"common" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)}
    counts = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = {tuple(r) for r in spelling.near_pairs(counts, crowd=256).collect()}
    by = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1 :]].add(w)
    want = {(a, b) for same in by.values() for a in same for b in same if a < b}
    assert got == want and want


def test_forms_of_nothing(documents):
    assert spelling.spelling_forms(documents((1, None), (2, "seldom"))).collect() == []
    assert spelling.spelling_forms(documents().limit(0)).collect() == []


# --- simhash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, distance=2):
    values = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted([(d, f"{v:016x}", least.get(find(i))) for i, ((d, _), v) in enumerate(zip(rows, values))], key=repr)


def test_simhash_groups_equal_brute_force(documents, collected):
    rng = random.Random(12)
    vocabulary = [f"W{i}é" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 60, 400]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\t", " \n "]).join(text).upper()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "x y z"), (903, "X  y\vz"), (None, "only here without id"), (3, rows[3][1]), (904, "a " * 200_000), (905, "b" * 300_000)]
    got = collected(simhash.near_duplicates(documents(*rows)), "doc_id", "fingerprint", "component_id")
    assert got == plain_groups(rows)
    assert simhash.near_duplicates(documents().limit(0)).collect() == []


@pytest.mark.parametrize("block, per_range", [(64, 200), (4096, 10_000)])
def test_index_finds_the_components_of_all_links(spark, monkeypatch, block, per_range):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "MIDDLE", min(block, simhash.MIDDLE))
    monkeypatch.setattr(simhash, "RANGE", per_range)
    rng = np.random.default_rng(8)
    # a dense cluster that differs in twelve bits, chains of two-bit steps, strangers, both ends
    cluster = np.uint64(0x0123456789ABCDEF) ^ np.unique(rng.integers(0, 1 << 12, 1500, dtype=np.uint64))
    chain = np.bitwise_xor.accumulate(np.concatenate([[np.uint64(77)], (np.uint64(3) << rng.integers(0, 62, 200, dtype=np.uint64))]))
    values = np.unique(np.concatenate([cluster, chain, rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2), np.array([0, 1, 2**64 - 1], np.uint64)]))
    classes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    edges = simhash.links(simhash.blocks(classes)).collect()
    assert all((r.x, r.y) != (r.y, r.x) for r in edges) and len(edges) < 40 * len(values)
    number = {int(v): i for i, v in enumerate(values.view(np.int64))}

    def labels(pairs):
        root = np.arange(len(values))
        for _ in range(len(values)):
            before = root.copy()
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
            if (before == root).all():
                return root

    near = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values) <= 2, 1))
    assert (labels([(number[r.x], number[r.y]) for r in edges]) == labels(near)).all()


def test_new_queries_are_registered():
    assert {"op11_whitening", "op12_spelling", "op13_simhash"} <= catalog.QUERIES.keys()
