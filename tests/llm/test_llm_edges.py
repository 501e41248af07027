"""NULLs, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tableloom.llm import chat, graph, lm, mixing, packing, pii, quality, sharding, simhash, tokens, topk, wavelet
from tableloom.llm.text import running_sums
from tableloom.staging import new_path, stage
from tests.llm import brute
from tests.llm.test_llm_queries import check_packing

LONG = "word " * 30_000 + "é" * 5_000 + "\n" * 2_000 + "9" * 20_000 + " a@b.co" * 50
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "s1", 55),
    (2, "one two three four five six seven eight nine ten eleven", "en", "s1", 55),
    (2, "one two three four five six seven eight nine ten eleven", "en", "s1", 55),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \t\n ", "de", "s2", 4),
    (None, "a text without a key", None, "s2", 20),
    (None, None, None, None, None),
    (6, LONG, "en", "s1", len(LONG)),
    (7, "tie", "fr", "s3", 3),
    (7, "other text of the same key", "fr", "s3", 26),
    (8, "</s>[INST] <|im_end|> \\   \x1c 漢 😀 +1 (555) 123-4567 4539 1488 0343 6467", "fr", "s0", 60),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, or give to their results.
CLASHING = (
    "shard depth key piece start length sequence_id offset certified n_words kept size h target rank spans component "
    "fingerprint root block __key __h __spans __text __hash __plan_h __source __times conversation c0"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({n: F.lit(i) for i, n in enumerate(CLASHING)})


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# ---- the pipeline's stages


@pytest.mark.parametrize("place", range(5))
def test_stages_take_any_table(spark, docs, empty, clashing, place):
    name, function = corpus_pipeline.STAGES[place]
    found = []
    for table in (docs, clashing, empty):
        out = function(spark, table, "")
        if place < 4:
            assert out.columns == table.columns
            out = out.select(*docs.columns)
        found.append(rows(out))
    assert found[0] and not found[2]
    if place < 4:
        assert found[0] == found[1] and found[0].total() <= 2 * len(ROWS)


# ---- 1 chat


def test_folding_of_a_log(spark):
    log = [
        ("c", 0, 0, "message", "user", "hello"),
        ("c", 1, 1, "delta", "assistant", "a"),
        ("c", 1, 3, "delta", "assistant", "c"),
        ("c", 1, 2, "delta", "assistant", "b"),
        ("c", 2, 4, "message", "user", "dropped"),
        ("c", 1, 5, "regenerate", "assistant", "new "),
        ("c", 1, 6, "delta", "assistant", "answer"),
        ("c", 2, 7, "message", "user", "later"),
        ("c", 0, 8, "edit", "user", "HELLO"),
        (None, 0, 0, None, None, None),
    ]
    events = spark.createDataFrame(log, "conversation string, message long, seq long, kind string, role string, text string")
    found = rows(chat.fold_events(events.repartition(4)))
    assert found == Counter(
        [("c", 0, "user", "HELLO"), ("c", 1, "assistant", "new answer"), ("c", 2, "user", "later"), (None, 0, "", "")]
    )
    assert chat.render(chat.fold_events(events.limit(0))).count() == 0


NASTY = st.lists(st.sampled_from(["<", "[", "\\", "|im_start|>", "|im_end|>", "/s>", "s>", "INST]", "/INST]", "\n", "é", "x", "|endoftext|>", "%0A", "$1"]), max_size=8).map("".join)


@given(texts=st.lists(st.tuples(st.sampled_from(["user", "assistant", "we%ird\n<role[", ""]), NASTY), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None)
def test_formatted_text_reads_back(spark, texts):
    messages = spark.createDataFrame([(0, i, r, t) for i, (r, t) in enumerate(texts)], "conversation long, message long, role string, text string")
    row = chat.read_back(chat.render(messages)).first()
    assert [(t["role"], t["text"]) for t in row.turns] == texts
    assert row.loss_texts == [t for r, t in texts if r == "assistant"]
    inside = row.formatted.replace("<|im_start|>", "", len(texts)).replace("<|im_end|>", "", len(texts))
    assert not [c for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]") if c in inside]


# ---- 2 packing


@given(lengths=st.lists(st.integers(1, 60), min_size=1, max_size=40), capacity=st.integers(60, 90))
@settings(max_examples=60, deadline=None)
def test_bounds_and_bins(lengths, capacity):
    sizes = np.array(lengths)
    bins, offsets, fill = packing.best_fit_decreasing(sizes, capacity)
    bound = packing.lower_bound(sizes, capacity)
    assert -(-sizes.sum() // capacity) <= bound <= len(fill) and fill.max() <= capacity
    for b in range(len(fill)):
        mine = sorted((int(o), int(s)) for o, s, x in zip(offsets, sizes, bins) if x == b)
        assert [o for o, _ in mine] == [sum(s for _, s in mine[:i]) for i in range(len(mine))]


def test_a_bound_beyond_the_sum():
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.lower_bound(np.zeros(0, int), 100) == 0


def test_parts_exchange_documents(spark):
    random.seed(8)
    sizes = [random.choice([70, 60, 45, 30, 25, 10, 5]) for _ in range(400)]
    pieces = stage(spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long"))
    alone = packing.pack(pieces, 100, part_pieces=20, rounds=1).collect()
    shared = packing.pack(pieces, 100, part_pieces=20).collect()
    used = lambda found: len({r.sequence_id for r in found})
    at_once = len(packing.best_fit_decreasing(np.array(sizes), 100)[2])
    assert packing.lower_bound(np.array(sizes), 100) <= at_once <= used(shared) < used(alone)
    for found in (alone, shared):
        assert sorted(r.doc_id for r in found) == list(range(400))
        fill = Counter()
        for r in found:
            fill[r.sequence_id] += r.length
        assert max(fill.values()) <= 100


def test_packing_of_any_texts(spark, docs, empty):
    pieces = stage(packing.token_pieces(docs, tokens.default_vocabulary()))
    check_packing(packing.pack(pieces).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack(stage(packing.token_pieces(empty, tokens.default_vocabulary()))).count() == 0


# ---- tokens


@given(text=st.text(st.sampled_from("ab ' \n\t\r\x0b\x1c\x85\xa0 漢é1!😀<|endoftext|>"), max_size=30))
@settings(max_examples=150, deadline=None)
def test_parts_give_the_ids_of_the_whole(text):
    tool = tokens.encoder(tokens.default_vocabulary())
    whole = tool.tokenizer.encode(text, add_special_tokens=False).ids
    assert tool.encode([text])[0].tolist() == whole


def test_a_small_cache_gives_the_same():
    small, large = (tokens.Encoder(tokens.default_vocabulary(), cached=n) for n in (4, 1000))
    texts = [f"w{i % 7} v{i % 3}\nu{i % 11} end" for i in range(60)]
    for i in range(0, 60, 6):
        assert [a.tolist() for a in small.encode(texts[i : i + 6])] == [a.tolist() for a in large.encode(texts[i : i + 6])]


# ---- 3 top-k


def test_top_k_against_all_pairs(spark):
    random.seed(1)
    vectors = [(i, [random.choice([0.0, 0.5, -0.25, 0.001, 1.0]) for _ in range(random.choice([3, 6]))]) for i in range(70)]
    vectors += [(5, [1.0, 1.0]), (90, None), (91, [1.0, None]), (92, [float("nan")]), (93, [float("inf"), 0.0]), (None, [1.0]), (94, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    usable = topk.usable_vectors(df)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors[:70]}
    plain = [(i, whole[i]) for i in whole] + [(5, [1024, 1024]), (94, [])]
    assert rows(usable.select("id")) == Counter((i,) for i, _ in plain)
    found = defaultdict(list)
    for r in topk.top_k(usable, usable.where("id % 7 = 0"), 4).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i, v in plain:
        if i % 7 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in plain if j != i)[:4]
            assert sorted(found[i]) == [(n, j, -s) for n, (s, j) in enumerate(scores, start=1)]
    nothing = topk.usable_vectors(df.limit(0))
    assert topk.top_k(nothing, nothing).count() == 0 and topk.top_k(usable, nothing).count() == 0
    one = usable.where("id = 7")
    assert topk.top_k(one, one).count() == 0


def test_top_k_of_any_size(spark):
    """Scores beyond 64 bits: the order is that of Python integers."""
    random.seed(2)
    sizes = [1e-3, 1.0, -1.0, 70000.0, 1e6, -1e6, 3e9, 1e30, -1e30, 1.5e300]
    vectors = [(i, [random.choice(sizes) for _ in range(random.choice([1, 2, 4]))]) for i in range(120)]
    vectors += [(200, [70000.0, 1.0]), (210, [70000.0, 1.0]), (220, [1.7e308]), (230, [-1.7e308])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    usable = topk.usable_vectors(df)
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in vectors}
    limit = (1 << 63) - 1
    found = defaultdict(list)
    for r in topk.top_k(usable, usable.where("id % 10 = 0"), 9).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i, v in whole.items():
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole.items() if j != i)[:9]
            assert sorted(found[i]) == [(n, j, max(-limit, min(limit, -s))) for n, (s, j) in enumerate(scores, start=1)]


# ---- 4 quality


def test_quality_of_any_table(spark, docs, empty, clashing):
    found = quality.quality(docs, carry=["doc_id"])
    wanted = Counter((r[0], *brute.quality_counts(r[1])) for r in ROWS)
    assert rows(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == wanted
    assert quality.quality(empty).count() == 0
    wide = quality.quality(clashing)
    assert wide.columns[: len(clashing.columns)] == clashing.columns and len(set(wide.columns)) == len(wide.columns)
    blank = docs.where("text IS NULL OR text = ''")
    assert {r.kept for r in quality.quality(blank).collect()} == {False}


@pytest.mark.parametrize("label", [None, "", "und", "xx"])
def test_junk_under_a_label_of_its_own(spark, sf_dir, label):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select("doc_id", F.lit(True).alias("bad"))
    marked = documents.join(bad, "doc_id", "left")
    own = marked.withColumn("lang", F.when(F.col("bad"), F.lit(label)).otherwise(F.col("lang")))
    odd = "bad AND NOT base_failed AND NOT kept"
    before = {r.doc_id for r in quality.quality(marked).where(odd).collect()}
    after = {r.doc_id for r in quality.quality(own).where(odd).collect()}
    assert before and before <= after


def test_every_language_has_a_reference(spark):
    """70 languages of more words than one in a script of its own, whose texts all stay."""
    latin = [(i, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "aeiou") * 8, f"l{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(70)]
    pick = random.Random(5)
    greek = [(100 + i, " ".join(chr(0x3B1 + pick.randrange(9)) * 7 for _ in range(120)), "el") for i in range(2)]
    # A label that names no language is no drawback, however many languages come before the text's own.
    stray = [(200, greek[0][1], None), (201, greek[1][1], "und"), (202, "#$ %& <> |* " * 60, None)]
    table = spark.createDataFrame(latin + greek + stray, "doc_id long, text string, lang string").repartition(3)
    judged = quality.quality(table)
    few = quality.quality(table.where("doc_id < 20 OR doc_id >= 100"))
    for found in (judged, few):
        assert sorted((r.doc_id, r.kept) for r in found.where("doc_id >= 200").collect()) == [(200, True), (201, True), (202, False)]
    judged = judged.where("lang = 'el'").collect()
    assert [(r.char_distance < 0.1, r.word_distance < 0.5, r.base_failed, r.kept) for r in judged] == [(True, True, False, True)] * 2
    assert quality.kept_documents(table).where("lang = 'el'").count() == 2
    assert rows(quality.quality(table, carry=["doc_id"]).select("doc_id")) == rows(table.select("doc_id"))


# ---- 5 near duplicates


@given(text=st.text(st.sampled_from("aB c\n\té"), max_size=40))
@settings(max_examples=60, deadline=None)
def test_fingerprints(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute.fingerprint(text)


def links_of(spark, prints):
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.close_links(spark.createDataFrame(signed, "fingerprint long"))
    return {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in found.collect()}


@pytest.mark.parametrize("spread", [3, 5, 64])
def test_links_connect_what_is_close(spark, spread):
    random.seed(spread)
    # Few bits that vary make crowded cells, many make lonely ones.
    bits = random.sample(range(64), spread)
    base = random.getrandbits(64)
    prints = {0, (1 << 64) - 1, 1 << 63}
    while len(prints) < (40 if spread == 64 else 2**spread - 2):
        p = base
        for b in random.sample(bits, random.randint(0, min(spread, 4))):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    links = links_of(spark, prints)
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, links))
    wanted = brute.groups(prints)
    joined = brute.groups(prints, bits=-1)
    place = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))
    for a, b in map(tuple, links):
        old, new = parent[place[a]], parent[place[b]]
        parent = [new if x == old else x for x in parent]
    same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == k) for k in g}
    assert same(parent) == same(wanted) and len(set(joined)) == len(prints)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    random.seed(6)
    found = rows(graph.components(spark.createDataFrame(random.sample(chain, len(chain)), "a long, b long").repartition(4)))
    assert found == Counter([(i, 0) for i in range(61)] + [(i, 100) for i in range(100, 140)])


def test_groups_of_any_table(spark, docs, empty, clashing):
    found = simhash.near_groups(docs).collect()
    prints = [brute.fingerprint(r[1]) for r in ROWS]
    numbers = brute.groups(prints)
    least = {n: min((r[0] for r, m in zip(ROWS, numbers) if m == n and r[0] is not None), default=None) for n in numbers}
    assert Counter((r.key, r.fingerprint % (1 << 64), r.component) for r in found) == Counter(
        (r[0], p, least[n]) for r, p, n in zip(ROWS, prints, numbers)
    )
    assert simhash.near_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert simhash.one_of_each(docs).count() == len(set(numbers)) == simhash.one_of_each(clashing).count()


def test_alike_groups_of_any_table(spark, docs, empty, clashing):
    numbers = brute.alike_groups([r[1] for r in ROWS])
    least = {n: min((r[0] for r, m in zip(ROWS, numbers) if m == n and r[0] is not None), default=None) for n in numbers}
    found = Counter((r.key, r.component) for r in simhash.alike_groups(docs).collect())
    assert found == Counter((r[0], least[n]) for r, n in zip(ROWS, numbers))
    assert simhash.alike_groups(empty).count() == 0 and simhash.one_of_each(empty, groups_of=simhash.alike_groups).count() == 0
    assert simhash.one_of_each(docs, groups_of=simhash.alike_groups).count() == len(set(numbers)) == simhash.one_of_each(clashing, groups_of=simhash.alike_groups).count()


def test_alike_groups_around_the_limit(spark):
    pick = random.Random(11)
    word = lambda: "".join(pick.choices("abcdefghij", k=5))
    texts = []
    for size in (12, 60, 400):
        # Near copies with one to many edits, and texts of one form that share too little.
        base = [word() for _ in range(size)]
        for edits in (0, 1, 1, 2, 3, 5, 8, 13):
            near = list(base)
            for place in pick.sample(range(size), min(edits, size)):
                near[place] = word()
            texts.append(" ".join(near))
        texts += [" ".join(base[: size * 7 // 10] + [word() for _ in range(size * 3 // 10)]) for _ in range(12)]
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)] + ["", None, " \n", "one two", "one two", "two one"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    numbers = brute.alike_groups(texts)
    assert {(r.key, r.component) for r in simhash.alike_groups(table).collect()} == set(enumerate(numbers))
    assert sorted(r.doc_id for r in simhash.one_of_each(table, groups_of=simhash.alike_groups).collect()) == sorted(set(numbers))


def test_unlike_texts_of_one_band_leave_it_one_by_one(spark, monkeypatch):
    # One band for all texts: each round names one text of it, and groups still come out whole.
    monkeypatch.setattr(simhash, "band_hashes", lambda hashes, factors: [7])
    texts = [f"{a} {b} c d e f g h" for a in "pqr" for b in "xyz"] + ["k l m n o p q r s t u v w x y z", "k l m n o p q r s t u v w x y z a"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.key, r.component) for r in simhash.alike_groups(table).collect()} == set(enumerate(brute.alike_groups(texts)))


# ---- 6 mixing


def test_mixing_of_any_table(spark, docs, empty):
    plan = mixing.mixing_plan(docs)
    assert plan.agg(F.sum("copies")).first()[0] == len(ROWS)
    assert {r.source for r in plan.collect()} == {r[3] for r in ROWS}
    assert all(r.repetitions + (r.extra > 0) <= 2 and r.extra <= r.copies for r in plan.collect())
    assert mixing.mixing_plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    silent = docs.where("text IS NULL")
    assert {r.repetitions + (r.extra > 0) for r in mixing.mixing_plan(silent).collect()} <= {0, 1, 2}


@pytest.mark.parametrize("key", [7, None])
def test_each_copy_has_its_own_decision(spark, key):
    """Copies of one row reach the target like different rows, whether or not other columns differ."""
    words = "ten words in each of these copies and no more"
    data = [(key, words, "s", i % 3) for i in range(1001)] + [(8, "a b c", "s", 0), (9, "d e", "s", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, more int").repartition(4)
    target = 1.5 * (1001 * 10 + 5)
    plan = mixing.mixing_plan(df)
    taken = plan.select(F.sum(F.col("size") * (F.col("repetitions") * F.col("copies") + F.col("extra")))).first()[0]
    mixed = mixing.mixed(df)
    assert abs(taken - target) <= 10 and mixed.columns == df.columns
    assert mixed.agg(F.sum(mixing.word_count("text"))).first()[0] == taken
    times = Counter(r.more for r in mixed.where("text like 'ten%'").collect())
    assert sum(times.values()) in (1501, 1502) and min(times.values()) >= 333


@pytest.mark.parametrize("weights", [(3, 1, 2), (1000, 1, 1)])
def test_water_fill(spark, weights):
    sizes = [5, 100, 40, 1, 0, 70, 33]
    table = [(s, weights[i % 3]) for i, s in enumerate(sizes)]
    sources = stage(spark.createDataFrame(table, "source_size long, weight int"))
    found = Counter(round(r.target, 6) for r in mixing.water_fill(sources, 1.5 * sum(sizes)).collect())
    wanted = brute.water_fill(sizes, [w for _, w in table], 1.5 * sum(sizes))
    assert found == Counter(round(t, 6) for t in wanted)


def test_word_counts(spark):
    for text in (None, "", " a\x0bb\x1cc d ", LONG):
        df = spark.createDataFrame([(text,)], "text string")
        assert df.select(mixing.word_count("text")).first()[0] == len(brute.WORD.findall(text or ""))


# ---- 7 wavelet matrix


@given(ids=st.lists(st.integers(0, 40), max_size=1300), value=st.integers(0, 70))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids, value):
    matrix = wavelet.WaveletMatrix.build(np.array(ids, np.uint16), 6)
    again = wavelet.WaveletMatrix(matrix.n, matrix.zeros, [p.tobytes() for p in matrix.planes], [r.tobytes() for r in matrix.ranks])
    assert again.decode().tolist() == ids
    places = [i for i, x in enumerate(ids) if x == value]
    assert again.count(value) == len(places) and again.occurrences(value) == places
    assert again.select(value, len(places)) == -1
    for place in {0, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert again.access(place) == ids[place] and again.rank(value, place) == sum(p < place for p in places)


def test_token_files_of_any_table(spark, docs, empty, clashing):
    for table in (docs, clashing):
        path = new_path(spark, "tokens")
        wavelet.write_tokens(table, path, tokens.default_vocabulary())
        files = wavelet.open_shards(spark, path)
        found = sorted(map(tuple, wavelet.read_documents(files).collect()), key=lambda r: r[1])
        assert [r[0] for r in found] == sorted((r[0] for r in ROWS), key=lambda k: (k is not None, k or 0))
        ids = brute.token_ids([r[1] for r in ROWS])
        assert Counter((r[0], r[2], r[3]) for r in found) == Counter((r[0], len(i) + 1, brute.crc(i + [2])) for r, i in zip(ROWS, ids))
        assert [r[1] for r in found] == [sum(x[2] for x in found[:i]) for i in range(len(found))]
        ends = [x for i in ids for x in i + [2]].count(2)
        assert wavelet.find_token(files, 2).count() == ends
    path = new_path(spark, "tokens")
    wavelet.write_tokens(empty, path, tokens.default_vocabulary())
    assert wavelet.read_documents(wavelet.open_shards(spark, path)).count() == 0


# ---- 8 personal data


PIECES = st.sampled_from(
    ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.0.0.1", "4539 1488 0343 6467", "4539148803436467",
     "1234-5678-9012-3456", "+1 (555) 123-4567", "+12", "+1((((", "++49 30 123456", " ", "", "é", "😀", ",", "\n", "9", "-", "."]
)


@given(texts=st.lists(st.lists(PIECES, max_size=9).map("".join), min_size=1, max_size=12))
@settings(max_examples=6, deadline=None)
def test_spans_against_a_plain_search(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.with_spans(df).select("doc_id", F.filter("spans", lambda s: s["kind"].isin(*pii.BASE)).alias("s"))
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.s] == brute.personal(texts[r.doc_id])


def test_added_kinds(spark):
    texts = [
        "iban GB82 WEST 1234 5698 7654 32 here",
        "iban GB82 WEST 1234 5698 7654 33 here",
        "my social security number is 123-45-6789",
        "the part 123-45-6789 fits",
        "account number 123456789",
        "item 123456789",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans if s.kind not in pii.BASE] for r in pii.with_spans(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["national_id"], 3: [], 4: ["account"], 5: []}
    masked = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert masked[0] == "iban <iban> here" and masked[3] == texts[3]


def test_account_numbers_before_capitals_and_digits(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    after = [" Thanks", " Please pay", " 2024 due", " BIC COBADEFF", "", ".", f" {gb} BIC"]
    texts = [f"IBAN {de}{a}" for a in after] + [f"REF AB12 CDEF 2024 {gb} A", f"IBAN {de}X and {de}x", f"{gb[:-1]}3 Please"]
    found = {r.doc_id: r.spans for r in pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    ibans = {i: [texts[i][s.start : s.end] for s in spans if s.kind == "iban"] for i, spans in found.items()}
    assert ibans == {**{i: [de] for i in range(6)}, 6: [de, gb], 7: [gb], 8: [], 9: []}


def test_context_reaches_past_other_matches(spark):
    texts = [
        "SSN: 123-45-6789, 987-65-4321",
        "account numbers 12345678, 87654321",
        "123456789 and 234567890 konto",
        "account number " + "1" * 12 + " " * 30 + "12345678",
    ]
    found = {r.doc_id: r.spans for r in pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = {i: [(s.start, s.end) for s in spans if s.kind not in pii.BASE] for i, spans in found.items()}
    assert kinds == {0: [(5, 16), (18, 29)], 1: [(16, 24), (26, 34)], 2: [(0, 9), (14, 23)], 3: [(15, 27)]}


def test_redaction_of_overlapping_spans(spark):
    text = "x 10.20.30.40 and +1 4539 1488 0343 6467 z, a@b.co."
    (row,) = pii.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = brute.personal(text)
    assert not any(text[a:b] in row.text for _, a, b in spans)
    assert row.text.startswith("x <ip> and ") and row.text.endswith(", <email>.")


def test_long_texts_are_searched_in_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 100_000, "a@" * 100_000, "a@b.c " * 3_000, "AB12" * 50_000]
    found = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: sum(s.kind == "email" for s in r.spans) for r in found}[5] == 3_000


def test_personal_data_of_any_table(spark, docs, empty, clashing):
    for table in (docs, clashing):
        name = "found"
        found = pii.with_spans(table, name=name).select("doc_id", "text", name).collect()
        for r in found:
            assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE] == brute.personal(r.text)
    assert pii.with_spans(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100])
def test_running_sums(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "a array<long>")
    assert df.select(running_sums(F.col("a"))).first()[0] == [sum(range(i)) for i in range(n)]


# ---- 9 language model


@given(values=st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted))
@settings(max_examples=40, deadline=None)
def test_elias_fano(values):
    coded = lm.EliasFano.build(np.array(values, np.uint64))
    assert coded.decode().tolist() == values
    for place in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert coded.get(place) == values[place]
        assert coded.successor(values[place], 0, len(values)) == values.index(values[place])
    assert coded.successor(1 << 50, 0, len(values)) == len(values)


def test_trie_look_up(tmp_path):
    random.seed(3)
    pairs = np.unique(np.array([random.randrange(40) << 32 | random.randrange(60) for _ in range(500)], np.uint64))
    logs = np.array([-random.random() * 6 for _ in pairs])
    trie = lm.Shard.build(pairs, logs, 60)
    asked = np.array([u << 32 | w for u in range(42) for w in range(60)], np.uint64)
    codes = trie.find(asked)
    known = dict(zip(pairs.tolist(), logs))
    for pair, code in zip(asked.tolist(), codes.tolist()):
        assert code == trie.find_one(pair >> 32, pair & 0xFFFFFFFF) and (code > 0) == (pair in known)
        if code:
            assert abs(float(trie.book[code - 1]) - known[pair]) <= 6 / 255 + 1e-6


def test_language_model_of_any_table(spark, docs, empty, clashing, tmp_path):
    wanted, tokens_seen = brute.language_scores([(r[0], r[1]) for r in ROWS], lm.BACKOFF)
    for table in (docs, clashing):
        scores, model = lm.score(table)
        found = scores.collect()
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        got = sorted(((r.key, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in found), key=key)
        assert got == sorted(((row[0], n, known, h, round(base, 6)) for row, (h, n, known, base, _) in zip(ROWS, wanted)), key=key)
        assert {r.train_tokens for r in found} == {tokens_seen}
        assert math.isclose(sum(r.score for r in found), sum(w[4] for w in wanted), rel_tol=0.01)
    shard = model.table.where("kind LIKE 'trie:words_head%'").first().shard
    mapped = lm.open_shard(model, shard, str(tmp_path))
    assert isinstance(mapped.codes, np.memmap) and mapped.words.n == lm.open_shard(model, shard).words.n
    assert lm.score(empty)[0].count() == 0
    held = docs.where("doc_id IS NULL")
    assert lm.score(held)[0].where("n_known = 0").count() == 2


def test_frequent_words_are_dealt_on():
    counts = lm.Counts(np.array([0, 1]), np.array([500_000, 1]), 1_000_000, 500_001)
    pairs = np.arange(1000, dtype=np.uint64)  # all after word 0
    assert len(set(lm.shard_of(pairs, counts, 16).tolist())) > 12


# ---- 10 sharding


def test_shards_fit_and_only_full_ones_split(spark):
    random.seed(4)
    data = [(i, random.choice([0, 1, 5, 50])) for i in range(600)] + [(7, 30)] * 200 + [(None, None), (None, 9), (1000, 5000)]
    df = spark.createDataFrame(data, "doc_id long, size long").withColumn("shard", F.lit("clash")).repartition(4)
    found = sharding.extendible_shards(df, "doc_id", F.col("size"), limit=400)
    assert found.columns == ["doc_id", "size", "shard", "_shard", "depth", "shard_bytes", "shard_rows"]
    got = found.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter(data)
    total, count = Counter(), Counter()
    for r in got:
        total[r._shard] += r.size or 0
        count[r._shard] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_rows) == (total[r._shard], count[r._shard])
        assert r.shard_bytes <= 400 or r.shard_rows == 1
    # The parent of a shard of the first round, with all below it, is above the limit.
    for shard in total:
        parent, bits = shard.split("/")
        if not parent and bits:
            below = sum(n for s, n in total.items() if ("".join(f"{int(h, 16):04b}" for h in s.split("/")[0]) + s.split("/")[1]).startswith(bits[:-1]))
            assert below > 400
    assert sharding.extendible_shards(df.limit(0), "doc_id", F.col("size")).count() == 0
    path = new_path(spark, "shards")
    sharding.write_shards(found.drop("shard").withColumnRenamed("_shard", "shard"), path)
    assert spark.read.parquet(path).count() == len(data)
