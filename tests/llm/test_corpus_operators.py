"""Operators across documents, conversations and vectors, and the pipeline, against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from platewise.llm import catalog, chat, graph, line_dedup, minhash, suffixes, topk
from platewise.llm.perfect_hash import Shard, shard_block
from tests.compare import differences, duck

STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), duck(sf_dir), catalog.ORACLES[name]) == []


# --- lines


def test_perfect_hash_numbers_its_keys_without_gaps():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        shard = Shard(shard_block(keys, keys ^ np.uint64(5), np.arange(len(keys)) + 1))
        assert sorted(shard.table.numbers(keys).tolist()) == list(range(len(keys)))
        assert (shard.probe(keys, keys ^ np.uint64(5)) == np.arange(len(keys)) + 1).all()
        other = rng.integers(0, 1 << 63, 500, dtype=np.uint64) | np.uint64(1 << 63)
        assert not shard.probe(other, other).any()


def plain_lines(rows, least=10):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least or not key(x)]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"send_bytes": -1}, {"shard_keys": 3}, {"send_bytes": -1, "shard_keys": 3}, {"send_bytes": -1, "shard_keys": 3, "part_lines": 5}])
def test_line_dedup_equals_brute_force(documents, collected, how):
    rng = random.Random(8)
    common = [" Shared line ", "shared LINE", "\tÀ propos\r", "x", "", "   ", "Another one here"]
    rows = [(i, "\n".join(rng.choice([*common, f"own {i} {rng.random()}"]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (502, "\n\n"), (None, "x\nown"), (503, "y" * 100_000 + "\nx"), (1, rows[1][1])]
    assert collected(line_dedup.line_digest(documents(*rows), **how)) == plain_lines(rows)


def test_routed_lines_of_many_copies_travel_once(documents, collected):
    """A crowd of equal rows and one long text, with parts of a few lines."""
    rows = [(7, "copied\nline\nown 7")] * 300 + [(8, "\n".join(f"line {i}" for i in range(2000)) + "\ncopied")]
    got = collected(line_dedup.line_digest(documents(*rows), send_bytes=-1, shard_keys=1, part_lines=3))
    assert got == plain_lines(rows) == collected(line_dedup.line_digest(documents(*rows)))


def test_lines_of_nine_documents_stay(documents, collected):
    rows = [(i, "nine" if i < 9 else "other") for i in range(12)]
    assert {r[2] for r in collected(line_dedup.line_digest(documents(*rows)))} == {0}
    assert line_dedup.line_digest(documents().limit(0)).collect() == []


def test_line_dedup_keeps_the_columns(documents):
    docs = documents(*[(i, "same\nown") for i in range(11)], (99, None))
    got = line_dedup.line_deduplicated(docs).select(*docs.columns)
    assert got.schema.names == docs.schema.names
    assert {(r.doc_id == 99, r.text, r.label, r.length) for r in got.collect()} == {(True, None, "y", 5), (False, "", "y", 5)}


# --- chat


def plain_turns(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), sha(learned)))
    return sorted(out, key=repr)


CHAT = [
    (1, 0, "system", "<<SYS>>[INST]\\0\\1"),
    (1, 1, "user", "a\\"),
    (1, 2, "assistant", "</s>é日\\\\<["),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
    (3, 0, "tool[<\\", "x[/TURN]"),
    (3, 0, "tool[<\\", "x[/TURN]"),
    (4, None, None, "no turn"),
    (4, 5, "assistant", "[" * 5000 + "\n\n"),
    (None, 0, "user", "no conversation"),
    (5, 1, "assistant", "<s>"),
    (5, 0, "user", "late row first"),
]


def test_chat_reads_back_what_went_in(spark, collected):
    turns = spark.createDataFrame([(*r, "extra") for r in CHAT], "conv_id long, turn long, role string, text string, segments string")
    got = chat.formatted_digest(turns)
    assert collected(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == plain_turns(CHAT)
    assert {r.conv_id: r.valid for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, None: False, -7: True}


def test_chat_of_nothing_and_of_another_template(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.formatted_digest(none).collect()] == [-7]
    template = chat.Template(begin="#", roles={"user": chat.Turn("{u}", "{/u}"), "assistant": chat.Turn("#a#", "#/a#", loss=True)}, after={"start": ("user",), "user": ("assistant",)}, other=("{r}", "{/r}", "{/t}"))
    rows = spark.createDataFrame([(1, 0, "user", "{u}#"), (1, 1, "assistant", "#a#{\\")], "conv_id long, turn long, role string, text string")
    row = chat.formatted(rows, template).first()
    assert row.valid and row.state == "assistant"
    assert [s.loss for s in row.segments] == [False, False, False, False, False, True, False]
    back = spark.createDataFrame([("".join(s.text for s in row.segments),)], "t string").select(chat.read_turns(chat.F.col("t"), template).alias("x")).first().x
    assert [tuple(t) for t in back] == [("user", "{u}#"), ("assistant", "#a#{\\")]


def test_chat_runs_no_python(spark, sf_dir):
    plan = catalog.QUERIES["op6_chat"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- top-k


def plain_top(rows, k=5):
    whole = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        asked = min(tuple(v) for i, v in whole if i == q)
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(asked, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"candidates": 7, "per_block": 2}])
def test_top_scores_equal_brute_force(spark, collected, how):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(260)]
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows += [(1000 + i, same) for i in range(90)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")]), (2004, [float("inf"), 0.0]), (None, [1.0] * 8), (2005, [9.0]), (50, rows[50][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert collected(topk.top_scores(table, **how), "query_id", "rank", "vec_id", "score") == plain_top(rounded)


def test_top_scores_with_few_or_no_rows(spark, collected):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_scores(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_scores(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    got = collected(topk.top_scores(spark.createDataFrame([(0, [1.0]), (3, [1.0]), (2, [1.0])], schema)), "vec_id", "rank")
    assert got == [(2, 1), (3, 2)]


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-20, 20, (4000, 4))
    vectors[7] = 256
    lists = topk.SortedLists(np.arange(4000), vectors)
    ((ids, scores),) = lists.best(np.array([-1]), np.array([[256, 256, 1, 1]]), 1)
    assert ids.tolist() == [7] and scores.tolist() == [256 * 514] and lists.depths[-1] < 4000


def test_top_scores_join_and_broadcast_nothing(spark, collected):
    """Blocks of queries times blocks of candidates went to the driver as one broadcast."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(6)]) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for how in ({}, {"held": 2}):
        found = topk.top_scores(table, candidates=40, per_block=3, **how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Broadcast|Join|Cartesian", plan)
        assert collected(found, "query_id", "rank", "vec_id", "score") == plain_top(rows)


def test_top_scores_of_large_and_wide_vectors(spark, collected):
    """Components beyond 16 and 32 bits, sums beyond single precision, widths that differ, more components than WIDTH."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1), *(rng.choice([1.0, 2e2, 1e4]) * rng.gauss(0, 1) if i % 7 == 0 else rng.gauss(0, 1) for _ in range(rng.choice([2, 69, 199])))]) for i in range(300)]
    rows[7][1][0] = 1e7
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert collected(topk.top_scores(table, candidates=60, per_block=4, held=1), "query_id", "rank", "vec_id", "score") == plain_top(rows)


def test_blocks_taken_one_after_the_other_keep_the_best():
    rng = np.random.default_rng(4)
    ids, vectors, queries = rng.permutation(3000), rng.integers(-3, 4, (3000, 12)), rng.integers(-3, 4, (40, 12))
    query_ids = np.concatenate([ids[:20], np.arange(5000, 5020)])
    asked = topk.Asked(query_ids, queries, 5)
    for rows in np.split(np.arange(3000), [3, 40, 1000, 1004]):
        asked.meet(topk.SortedLists(ids[rows], vectors[rows].astype(np.int16)))
    for query_id, query, found in zip(query_ids, queries, asked.found):
        best = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors) if i != query_id)[:5]
        assert [(-s, i) for i, s in zip(*(x.tolist() for x in found))] == best


# --- near-duplicates


def plain_components(rows, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                home[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    out = [(d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)]
    return sorted([(*x, x[0] == x[2]) for x in out], key=repr)


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    rows = []
    for _ in range(6):
        words = [word() for _ in range(150)]
        for _ in range(rng.choice((2, 12))):
            # chains: each copy changes the one before a little
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word().upper()
            rows.append(" ".join(words))
    rows += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows += [None, "", "  \n", "One two", "one  TWO", "two one", "a b c d e", "A b c\nd e", rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(documents, collected, seed):
    rows = near_rows(seed)
    rows += [(None, rows[3][1]), rows[5], (None, "nobody else has these words here")]
    assert collected(minhash.components_digest(documents(*rows)), "doc_id", "n_shingles", "component_id", "kept") == plain_components(rows)


def test_the_last_round_alone_loses_no_link(spark, documents):
    """Without the rounds that link to one member, a bucket's members still meet."""
    rows = near_rows(4)
    docs = documents(*rows)
    classes = minhash.signatures(docs).filter("n_shingles > 0").groupBy("shingles", "n_shingles")
    one = minhash.F.min(minhash.F.struct("doc_id", "text_hash")).alias("one")
    classes = minhash.stored(classes.agg(one, minhash.F.first("bands").alias("bands"), minhash.F.first("bits").alias("bits")).withColumn("id", minhash.F.monotonically_increasing_id()), "classes")
    kinds = [{(r.id, r.label) for r in minhash.class_components(classes, docs, star_rounds=n).collect()} for n in (0, 2)]
    assert kinds[0] == kinds[1]


def test_bit_agreement_estimates_similarity(documents):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(400)]
    rows = minhash.signatures(documents((1, " ".join(words)), (2, " ".join([*words[:390], *"q w e r t y u i o p".split()])), (3, " ".join(words[::-1])))).collect()
    bits = {r.doc_id: [x & (1 << 64) - 1 for x in r.bits] for r in rows}
    equal = lambda a, b: sum((x >> 2 * i & 3) == (y >> 2 * i & 3) for x, y in zip(bits[a], bits[b]) for i in range(32))
    assert equal(1, 2) >= minhash.least_agreement() > equal(1, 3)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201)], "x long, y long")
    got = {r.id: r.label for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_one_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents((4, text), (2, text.upper()), (2, text.upper()), (None, text), (5, ""), (6, None), (7, "own words"))
    got = minhash.one_of_each(docs)
    assert got.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in got.collect()) == [2, 5, 6, 7]
    assert minhash.components_digest(documents().limit(0)).collect() == []


@pytest.mark.parametrize("linked", [True, False])
def test_unlike_texts_stay_without_an_id_or_with_a_shared_one(documents, linked):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4])]
    # near-duplicates: of one without an id, and of one with the shared id
    more = [(None, texts[0] + " end"), (8, texts[4] + " end")] if linked else []
    got = [(r.doc_id, r.text.removesuffix(" end")) for r in minhash.one_of_each(documents(*rows, *more)).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


# --- repeated byte strings


def plain_repeats(rows, span=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + span] for b in texts for i in range(len(b) - span + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), runs, sha(bytes(x for x, y in zip(b, gone) if not y))))
    return sorted(out, key=repr)


def repeat_rows():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    base = noise(1500)
    rows = [(0, base), (1, base[100:900] + "xyz" + base[900:]), (2, base[:250]), (3, "q" * 199), (4, "z" * 1000), (5, "z" * 450)]
    rows += [(6, None), (7, ""), (8, "ab" * 400), (9, "c" + base[300:520]), (10, "d" + base[300:520] + "e"), (11, base), (11, base)]
    rows += [(None, base[50:400]), (12, "A" + base[40:300] + "B" + base[40:300] + "C")]
    for i in range(13, 50):
        at = rng.randint(0, 1200)
        rows.append((i, noise(rng.randint(0, 300)) + base[at : at + rng.randint(50, 400)] + noise(rng.randint(0, 300))))
    return rows


@pytest.mark.parametrize("part", [suffixes.PART, 4, 0])
def test_repeats_equal_brute_force(documents, collected, part):
    rows = repeat_rows()
    assert collected(suffixes.removed_digest(documents(*rows), part=part)) == plain_repeats(rows)


def test_long_texts_are_seen_in_overlapping_segments(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = pa.array(["".join(rng.choice("abc") for _ in range(n)) for n in (3000, 199, 200, 700)])
    key = lambda found: {(t, a) for t, a in zip(found["text"].tolist(), (found["start"] + found["left"]).tolist())}
    whole = key(suffixes.anchors(texts))
    monkeypatch.setattr(suffixes, "SEGMENT", 512)
    assert key(suffixes.anchors(texts)) == whole


def test_suffix_order_and_its_verification():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    starts = rng.integers(0, 500, 300)
    limits = rng.integers(0, 100, 300)
    groups = rng.integers(0, 9, 300)
    suffix = suffixes.Suffixes(data, starts, limits, groups)
    text = [data[s : s + n].tobytes() for s, n in zip(starts, limits)]
    order, same = suffix.sorted()
    assert order.tolist() == sorted(range(300), key=lambda i: (groups[i], text[i], i))
    plain = suffix._sorted_plainly(np.append(True, groups[order][1:] != groups[order][:-1]))
    assert (plain[0] == order).all() and (plain[1] == same).all()
    # with hashes that all collide the verification notices and the bytes decide
    suffix.prefixes.sums[:] = 0
    order, same = suffix.sorted()
    assert (plain[0] == order).all() and (plain[1] == same).all()


def test_cut_documents_keep_their_columns(documents):
    rows = repeat_rows()
    docs = documents(*rows)
    got = suffixes.without_repeats(docs)
    assert got.schema.names == docs.schema.names
    by_id = {r.doc_id: r.text for r in got.collect()}
    assert by_id[6] is None and by_id[7] == "" and by_id[3] == "q" * 199 and by_id[4] == "" and by_id[11] == ""
    assert suffixes.removed_digest(documents().limit(0)).collect() == []


# --- pipeline


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    schema = docs.schema.names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    quality, lines, near, suffix, packing = (f for _, f in corpus_pipeline.STAGES)

    kept = minhash.stored(quality(spark, docs, sf_dir), "t1")
    labels = {r.doc_id: r for r in catalog.table(spark, sf_dir, "labels").collect()}
    stay = {r.doc_id for r in kept.collect()}
    clean = [d for d, x in labels.items() if x.quality == 1 and x.toxic == 0]
    bad = [d for d, x in labels.items() if x.quality == 0 or x.toxic == 1]
    assert sum(d in stay for d in clean) >= 0.97 * len(clean) and sum(d in stay for d in bad) <= 0.5 * len(bad)

    cut = minhash.stored(lines(spark, kept, sf_dir), "t2")
    rows = [(r.doc_id, before[r.doc_id]) for r in kept.collect()]
    assert sorted((r.doc_id, sha(r.text)) for r in cut.collect()) == sorted((d, h) for d, _, _, h in plain_lines(rows))
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = minhash.stored(near(spark, cut, sf_dir), "t3")
    want = {d for d, _, _, stays in plain_components([(r.doc_id, r.text) for r in cut.collect()], percent=80) if stays}
    assert {r.doc_id for r in single.collect()} == want

    short = minhash.stored(suffix(spark, single, sf_dir), "t4")
    plain = {d: h for d, _, n, _, h in plain_repeats([(r.doc_id, r.text) for r in single.collect()]) if n == 0}
    got = {r.doc_id: sha(r.text) for r in short.collect()}
    assert len(got) == len(want) and all(got[d] == h for d, h in plain.items())

    packed = packing(spark, short, sf_dir)
    assert {r.doc_id for r in packed.collect()} == want
    for stage in (kept, cut, single, short):
        assert stage.schema.names == schema
