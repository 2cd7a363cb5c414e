"""Long white space, clashing column names, strings that collide under weak hashes, many equal rows."""

import collections
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from platewise.llm import encoding, language_id, line_dedup, minhash, packing, quality_rules, rawtext, suffixes, weak_labels
from platewise.llm.rawtext import Prefixes


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " ", " \n"])
def test_packing_of_long_white_space(documents, blank):
    public = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    public.no_truncation()
    text = "a" + blank * (1_200_000 // len(blank)) + "b"
    ids = np.array([*public.encode(text, add_special_tokens=False).ids, 0], "<u4")
    rows = packing.packed(documents((1, text), (2, "short")), public_tokenizers.path("byte_bpe_50k.json")).filter("doc_id = 1").collect()
    assert sum(r.length for r in rows) == len(ids)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_long_blanks_are_told_from_long_texts():
    assert packing.has_long_blank("x" + "\n" * 100_000) and not packing.has_long_blank(("x" + " " * 99_999) * 3)


INTERNAL = ("__own", "__doc", "__hash", "__lines", "__dropped", "__row", "__hits", "__spans", "__quality", "__kept", "column_0", "column_3", "shard", "anchor", "band", "component_id", "text_hash", "N_SHINGLES")


def test_stages_keep_columns_of_any_name(spark):
    passage = " ".join(f"word{i} passage" for i in range(60))
    texts = [f"shared line\nown text number {i} with some words {i * 7} of its own and {i * i} more\n{passage if i < 2 else ''}" for i in range(14)]
    rows = [(i, t, *[100 * i + k for k in range(len(INTERNAL))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in INTERNAL))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    stages = {
        "classifier": weak_labels.accepted(docs, labels, reject=1.1),
        "lines": line_dedup.without_shared_lines(docs),
        "routed lines": line_dedup.without_shared_lines(docs, send_bytes=-1),
        "near": minhash.one_of_each(docs),
        "suffixes": suffixes.without_repeats(docs),
    }
    for name, result in stages.items():
        assert result.columns == docs.columns, name
        got = result.collect()
        assert got and all(tuple(r)[2:] == rows[r.doc_id][2:] for r in got), name
        assert len(got) == (14 if name != "near" else len(got))
    assert all("shared line" not in r.text for r in stages["lines"].collect() + stages["routed lines"].collect())
    assert all(passage not in r.text for r in stages["suffixes"].collect())


def test_one_letter_makes_a_language(documents):
    docs = documents(*[(i, "the cat drinks water and the dog too", "en") for i in range(20)], *[(100 + i, "le chat boit et le chien aussi", "fr") for i in range(20)],
                     (200, "H₂O"), (201, "m²"), (202, "½cup"), (203, "m² ½cup"), (204, "₂ ½ 3_"), (205, "日"))
    got = {r.doc_id: r for r in language_id.identified(docs).collect() if r.doc_id >= 200}
    assert all(got[i].lang_pred in ("en", "fr") and 0 < got[i].score <= 1 for i in (200, 201, 202, 203, 205))
    assert (got[204].lang_pred, got[204].score) == ("und", 0.0)


def thue_morse(length, one, two):
    return "".join((one, two)[i.bit_count() % 2] for i in range(length))


def test_strings_alike_modulo_a_power_of_two_are_told_apart(documents):
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    data = np.frombuffer((one + two).encode(), np.uint8)
    hashes = Prefixes(data).of(np.array([0, 2048]), np.array([2048, 4096]))
    assert hashes[0] != hashes[1]
    rows = quality_rules.quality_rules(documents((1, f"{one}\n{two}"), (2, f"{one}\n{one}"))).collect()
    assert {r.doc_id: r.n_dup_lines for r in rows} == {1: 0, 2: 1}
    groups = minhash.components_digest(documents((1, one), (2, two), (3, one))).collect()
    assert {r.doc_id: r.component_id for r in groups} == {1: 1, 2: 2, 3: 1}
    cut = suffixes.removed_digest(documents((1, one[:700] + "x"), (2, two[:700] + "y"))).collect()
    plain = lambda a, b: len({i + k for i in range(len(a) - 199) if a[i : i + 200] in b or a.count(a[i : i + 200]) > 1 for k in range(200)})
    assert {r.doc_id: r.n_removed for r in cut} == {1: plain(one[:700] + "x", two[:700] + "y"), 2: plain(two[:700] + "y", one[:700] + "x")}


def test_hashes_of_equal_parts_agree_wherever_they_stand():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000, dtype=np.uint8)
    prefixes = Prefixes(data)
    starts = rng.integers(0, 4990, 3000)
    found = collections.defaultdict(set)
    for start, value in zip(starts, prefixes.of(starts, starts + 8)):
        found[data[start : start + 8].tobytes()].add(int(value))
    assert all(len(values) == 1 for values in found.values()) and len({v for vs in found.values() for v in vs}) == len(found)
    long = np.full(5 << 20, 255, np.uint8)
    wide = Prefixes(long)
    assert wide.of(np.array([0]), np.array([4 << 20])) == wide.of(np.array([1 << 20]), np.array([5 << 20]))


def test_equal_rows_bring_their_ranges_once(documents):
    text = " ".join(f"w{i}" for i in range(150))
    spans = suffixes.repeats(documents(*[(None, text)] * 300)).collect()
    assert len(spans) == 1 and len(spans[0]["__spans"]) < 100
    cut = suffixes.removed_digest(documents(*[(None, text)] * 300)).collect()
    assert len(cut) == 300 and {r.n_removed for r in cut} == {len(text)}


def test_frequent_words_come_by_a_threshold(documents, spark):
    text = "a a a a b b b c c c d d e f"
    docs = documents((1, text), (2, None), (3, ""), (4, text))
    assert encoding.frequent_words(docs, 3) == [" a", " b", " c"]
    assert encoding.frequent_words(docs, 2) == [" a"]  # b and c are equally frequent: none of them
    assert encoding.frequent_words(docs, 100) == [" a", " b", " c", " d", " e", " f"]
    assert encoding.frequent_words(documents((1, "once only")), 5) == [] and encoding.frequent_words(docs.limit(0), 5) == []
    plan = spark.createDataFrame([(i,) for i in (5, 5, 3, 1)], "n long")
    assert [encoding.least_count(plan, most) for most in (1, 2, 3, 4)] == [1 << 62, 5, 3, 1]


def test_a_worker_remembers_a_bounded_number_of_letters(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_LETTERS", 5000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, public = encoding.Encoder(encoding.Vocabulary(path), None), tokenizers.Tokenizer.from_file(path)
    for i in range(30):
        text = f"{'x' * 400}{i} again {'y' * 300}{i} \n{i}"
        assert model.encode([text])[0].tolist() == public.encode(text, add_special_tokens=False).ids
        assert sum(map(len, model.known)) < 5000 + 2 * len(text)


class Caught(Exception):
    """Holds the function that was to run on batches."""


@pytest.mark.parametrize("stage", ["classifier's sample", "classifier", "signatures", "sets", "anchors"])
def test_texts_are_hashed_in_little_memory(documents, spark, monkeypatch, stage):
    def caught(self, run, schema):
        raise Caught(run)

    docs = documents((1, "some words here"), (2, "and there"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    classes = spark.createDataFrame([(1, (1, 5))], "id long, one struct<doc_id: long, text_hash: long>")
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    monkeypatch.setattr(rawtext, "_powers", {})
    model = np.ones(weak_labels.FEATURES, np.float32), 0.0
    if stage == "classifier":
        monkeypatch.setattr(weak_labels, "fitted", lambda *_: model)
    call = {
        "classifier's sample": lambda: weak_labels.fitted(docs.select("doc_id", "text"), labels),
        "classifier": lambda: weak_labels.scored(docs, labels),
        "signatures": lambda: minhash.signatures(docs),
        "sets": lambda: minhash.class_sets(classes.select("id"), classes, docs),
        "anchors": lambda: suffixes.anchor_table(docs),
    }[stage]
    with pytest.raises(Caught) as held:
        call()
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 100_000, 500))) for _ in range(2000)]
    numbers = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"doc_id": numbers, "text": pa.array(texts), "text_hash": numbers, "id": numbers, "label": pa.array([0] * len(texts), pa.int32())})
    run = held.value.args[0]
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= len(texts) and peak < 60 << 20
