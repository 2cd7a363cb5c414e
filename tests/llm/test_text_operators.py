"""Operators on single documents: encoding, quality rules, packing, language, quality classifier."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from platewise.llm import encoding, language_id, packing, quality_rules, weak_labels
from platewise.llm.catalog import VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None,
    "",
    " ",
    "a  b   c ",
    "\n x\n\n y \t z\r\n",
    "it's we'll I'D 's don't",
    "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftext",
    "日本語 テキスト 123 4a \u0085 　x",
    "a" * 5000,
    "\x00 null \x0b\x0c",
    "word " * 3000,
]


def texts(seed, count=300, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\t'stal1é!<|日") for _ in range(rng.randint(0, size))) for _ in range(count)]


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(VOCABULARY)


def digest(data):
    return hashlib.sha256(data).hexdigest()


def ids_of(public, text):
    return public.encode(text or "", add_special_tokens=False).ids


def test_round_trip_equals_the_public_tokenizer(spark, documents, collected, public):
    rows = list(enumerate(ODD + texts(1))) + [(0, None), (7, "same"), (7, "same"), (None, "no id")]
    got = collected(encoding.round_trip(documents(*rows), VOCABULARY, words=200), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for doc_id, text in rows:
        ids = ids_of(public, text)
        back = public.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(back.encode())))
    assert got == sorted(want, key=repr)


def test_round_trip_of_nothing(documents):
    assert encoding.round_trip(documents().limit(0), VOCABULARY).collect() == []


def test_automaton_shares_states_and_finds_its_words_only(tmp_path):
    words = sorted({w.encode() for w in ("walking", "talking", "walk", "talk", "walked", "talked", "é")})
    block = encoding.compiled({w: np.arange(i + 1) for i, w in enumerate(words)})
    (tmp_path / "lexicon").write_bytes(block)
    lexicon = encoding.Lexicon(str(tmp_path / "lexicon"))
    assert lexicon.places(words).tolist() == list(range(len(words)))
    assert lexicon.places([b"walkin", b"", b"alking", b"talkingx"]).tolist() == [-1] * 4
    assert (lexicon.ids[lexicon.starts[3] : lexicon.starts[4]] == np.arange(4)).all()
    # walk and talk share all that follows their first letters
    assert len(lexicon.accepting) < sum(map(len, words)) // 2


def test_automaton_without_words(tmp_path):
    (tmp_path / "lexicon").write_bytes(encoding.compiled({}))
    assert encoding.Lexicon(str(tmp_path / "lexicon")).places([b"a"]).tolist() == [-1]


def test_the_lexicon_changes_no_result(tmp_path, public):
    model = encoding.Vocabulary(VOCABULARY)
    sample = [t or "" for t in ODD] + texts(2)
    words = sorted({w.encode() for t in sample for w in model.split(t)} - {b""})[::2]
    words = [w for w in words if len(w) <= encoding.LEXICON_BYTES]
    (tmp_path / "lexicon").write_bytes(encoding.compiled(dict(zip(words, model.merged(words)))))
    with_it = encoding.Encoder(model, encoding.Lexicon(str(tmp_path / "lexicon"))).encode(sample)
    assert [x.tolist() for x in with_it] == [ids_of(public, t) for t in sample]


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(inside), failed


def plain_coverage(text, n):
    words = WORD.findall(text or "")
    counts = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {j for i in range(len(words) - n + 1) if counts[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


def test_quality_rules_equal_brute_force(documents, collected):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice(("the", "é", "cat", "sat", "on", "mat", "#", "x<y")) for _ in range(rng.randint(1, 12)))
    rows = list(enumerate(ODD + texts(3) + ["\n".join(rng.choice([sentence(), "again and again"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]))
    rows += [rows[-1], (None, "a b")]
    got = quality_rules.quality_rules(documents(*rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, "doc_id", *names) == sorted([(i, *plain_measures(t)) for i, t in rows], key=repr)
    limits = quality_rules.Limits()
    for row in got.collect():
        text = dict(rows)[row.doc_id]
        shares = [plain_coverage(text, n) for n in limits.repeated_shares]
        assert row.repeated_share == pytest.approx(max(shares))
        repeated = {f"repeated_{n}" for n, share in zip(limits.repeated_shares, shares) if share > limits.repeated_shares[n]}
        assert repeated == {r for r in row.failed_rules.split(",") if r.startswith("repeated_")}
        assert row.kept == (not row.base_failed and not row.failed_rules)


def test_quality_rules_keep_prose_and_drop_repetition(documents):
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200))
    got = quality_rules.quality_rules(documents((1, prose), (2, (prose[:300] + "\n") * 9), (3, "# " * 20 + prose[:900])))
    assert {r.doc_id: r.kept for r in got.collect()} == {1: True, 2: False, 3: False}


def check_plan(counts, capacity):
    plan = packing.Plan(counts, capacity)
    held = collections.defaultdict(list)
    for size, count in counts.items():
        for where, offset in zip(*plan.places(np.full(count, size), np.arange(count))):
            held[int(where)].append((int(offset), size))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * size > capacity for _, size in parts) <= 2
    assert len(held) == plan.sequences
    return plan.sequences


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_gapless_and_close_to_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 64, 2048))
    counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.choice((1, 20, 3000))))
    counts[rng.randint(1, capacity)] += rng.choice((0, 1000))
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    halves = sum(n for s, n in counts.items() if 2 * s > capacity)
    assert check_plan(counts, capacity) <= 1.25 * max(least, halves) + 1


def test_plan_of_nothing_and_of_full_pieces():
    assert check_plan({}, 2048) == 0
    assert check_plan({2048: 3, 1: 5}, 2048) == 4
    assert check_plan({1: 100_000}, 2048) == 49


def test_packing_places_every_token_once(documents, public):
    rows = list(enumerate(ODD + texts(6))) + [(3, "same"), (3, "same"), (None, "no id")]
    got = packing.packed(documents(*rows), VOCABULARY, capacity=64).collect()
    ids = collections.defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(ids_of(public, text) + [0])
    for r in got:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        assert (r.start == 0) == (r.piece == 0) and r.length <= 64
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc_id, own in by_doc.items():
        assert sum(r.length for r in own) == sum(map(len, ids[doc_id]))
        if len(ids[doc_id]) == 1 and len(own) > 1:
            assert [r.length for r in sorted(own, key=lambda r: r.piece)[1:]] == [64] * (len(own) - 1)
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 64


def test_packing_nothing(documents):
    assert packing.packed(documents().limit(0), VOCABULARY).collect() == []


SPEECH = {"aa": "dom kat lun rep", "bb": "vis olk uzn ehh", "cc": "pqr xyz wvu tsq"}


def spoken(count, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(SPEECH[lang].split()) + rng.choice(("", "a", "e")) for _ in range(20)), lang) for i in range(count) for lang in [sorted(SPEECH)[i % 3]]]


def test_language_of_held_out_documents(documents):
    rows = spoken(300)
    extra = [(900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (None, "dom kat", None), (903, "katlun domrep", None), (903, "katlun domrep", None)]
    got = language_id.identified(documents(*rows, *extra)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    assert by_id[903].lang_pred == by_id[None].lang_pred == "aa" and by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_language_backs_off_to_shorter_grams():
    grams = ["lk", "zy", "q", "k", "w"], np.array([(0, 3), (3, 0), (9, 0), (9, 0), (0, 18)], float)
    model = language_id.Model(["a", "b"], (["dom"], np.array([(5.0, 0.0)])), grams)
    assert model.word("dom").argmax() == 0
    assert model.word("xlkx").argmax() == 1  # the longest known n-gram decides, not the shorter k
    assert model.word("zqz").argmax() == 0
    assert model.word("zzz").tolist() == [0, 0]


def test_language_of_unbroken_runs(documents):
    rows = [(i, t.replace(" ", "") if lang == "cc" else t, lang) for i, t, lang in spoken(300)]  # cc is never written with spaces
    unbroken = [(1000 + i, t.replace(" ", "") * 3, lang) for i, t, lang in spoken(60, seed=5)]
    got = {r.doc_id: r for r in language_id.identified(documents(*rows, *((i, t, None) for i, t, _ in unbroken))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in unbroken)
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang == "cc")


def test_grams_of_long_runs_are_all_counted(documents):
    rng = random.Random(4)
    runs = ["".join(rng.choice("abcdé𐐨") for _ in range(n)) for n in (1, 40, 41, 57, 58, 59, 60, 61, 62, 63, 64, 65, 122, 123, 124, 125, 126, 127, 128, 129, 500)]
    model = language_id.learned(documents(*((i, f"{run} ab", "aa") for i, run in enumerate(runs))))
    words = collections.Counter(w for run in runs for w in (run, "ab") if len(w) <= language_id.WORD_CHARS)
    grams = collections.Counter()
    for word in (w for run in runs for w in (f"^{run}$", "^ab$")):
        grams.update(word[i : i + n] for n in range(1, language_id.LONGEST_GRAM + 1) for i in range(len(word) - n + 1))
    plain = language_id.Model(["aa"], *((list(c), np.array([[float(n)] for n in c.values()])) for c in (words, grams)))
    for (rows, table), (other, expected) in zip([model.words, *model.grams], [plain.words, *plain.grams]):
        assert rows.keys() == other.keys()
        assert all(np.isclose(table[at], expected[other[key]]).all() for key, at in rows.items())


def test_a_large_language_displaces_no_small_one(documents):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(50)), "aa") for i in range(60)]
    rows += [(i, " ".join(rng.choice(("stu", "vwx", "yzs", "tvy", "uwz")) for _ in range(3)), "bb") for i in range(60, 70)]
    model = language_id.learned(documents(*rows), words=8, grams=20)
    for lang in ("aa", "bb"):
        count = collections.Counter(w for _, t, l in rows if l == lang for w in t.split())
        assert set(sorted(count, key=lambda w: (-count[w], w))[:4]) <= model.words[0].keys()
    assert len(model.words[0]) == 8 and sum(len(keys) for keys, _ in model.grams) == 20
    assert model.predict(["stu vwx yzs", "syv tux", "abcd efgh"]) == [("bb", pytest.approx(1, abs=0.1)), ("bb", pytest.approx(1, abs=0.5)), ("aa", pytest.approx(1, abs=0.5))]


def test_least_counts_leave_little_to_sort(spark):
    rng = random.Random(9)
    rows = [(rng.choice((0, 1, 1, 2, 3, 5, 8, 900)), rng.randint(0, 4)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a long, b int")
    for limits in ({"a": 37, "b": 5}, {"a": 1, "b": 399}, {"a": 0, "b": 10_000}):
        least = language_id.least_counts(frame, limits)
        for place, (name, limit) in enumerate(limits.items()):
            values = sorted((row[place] for row in rows if row[place] > 0), reverse=True)
            reached = [n for n in values if n >= least[name]]
            assert reached[:limit] == values[:limit] and (limit == 0) == (not reached)
            assert sum(n > least[name] for n in reached) < max(limit, 1)
    assert language_id.least_counts(frame.limit(0), {"a": 3}) == {"a": 1 << 62}


def test_language_without_anything_to_learn(documents):
    got = language_id.identified(documents((1, "some words"), (2, None))).collect()
    assert {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}
    assert language_id.identified(documents().limit(0)).collect() == []


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    bad = rng.random(4000) < 0.3
    rates = (0.95, 0.8, 0.65)
    calls = np.stack([np.where(rng.random(4000) < rate, bad, ~bad) for rate in rates], axis=1).astype(int)
    calls[rng.random(calls.shape) < 0.2] = -1
    probability, accuracy = weak_labels.posterior(calls)
    assert accuracy == pytest.approx(rates, abs=0.05)
    assert ((probability > 0.5) == bad).mean() > 0.9


def judged_rows(count, seed=1):
    """Plain prose; shouted or symbol-ridden junk; prose with bad words. Only the labels know the last."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(80)]
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            for k in range(0, 80, 20):
                words[k] = rng.choice(("zorgvile", "zorgvast", "quuxbad"))
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    return rows, labels


def test_classifier_on_held_out_documents(spark, documents):
    rows, labels = judged_rows(1200)
    known = spark.createDataFrame([x for x in labels if x[0] < 800] + [(1, 0, 0), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    extra = [(5000, None), (5001, ""), (5002, "12 !!"), (None, rows[0][1]), (0, rows[0][1])]
    got = weak_labels.quality_verdicts(documents(*rows, *extra), known).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: q == 1 and t == 0 for i, q, t in labels}
    held = [(r.kept, truth[r.doc_id]) for r in got if r.doc_id is not None and 800 <= r.doc_id < 1200]
    assert sum(a == b for a, b in held) / len(held) >= 0.97
    assert all(not r.kept and r.quality == 0 for r in got if r.doc_id in (5000, 5001, 5002))
    assert next(r for r in got if r.doc_id is None).kept


def test_classifier_without_labels_or_documents(spark, documents):
    rows, labels = judged_rows(400)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in weak_labels.quality_verdicts(documents(*rows), none).collect()}
    assert sum(got[i] for i, q, _ in labels if q == 1) / 300 > 0.95
    assert sum(got[i] for i, q, _ in labels if q == 0) / 100 < 0.05
    assert weak_labels.quality_verdicts(documents().limit(0), none).collect() == []


def test_vocabulary_file_is_read_not_copied():
    with open(VOCABULARY, encoding="utf-8") as file:
        assert len(json.load(file)["model"]["vocab"]) > 50_000
    assert pa.array([None, "a"]).null_count == 1
