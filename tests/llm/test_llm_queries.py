"""The registered queries: against DuckDB where SQL says it, else against brute force."""

import math
from collections import Counter, defaultdict

import pytest

from tableloom.llm import lm, mixing, packing
from tableloom.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op8_personal_data", "op10_extendible_sharding"])
def test_native_plans_have_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop") if word in plan]


def check_packing(rows, texts, capacity=2048, end=0):
    ids = [i + [end] for i in brute.token_ids([t for _, t in texts])]
    wanted = Counter()
    for (key, _), tokens in zip(texts, ids):
        first = len(tokens) % capacity or capacity
        cuts = [0, *range(first, len(tokens) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[key, i, a, b - a, brute.crc(tokens[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end_of = 0
        for offset, length in sorted(places):
            assert offset == end_of
            end_of += length
        assert end_of <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, sf_dir, documents):
    rows = QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    used, bound = check_packing(rows, [(d, t) for d, t, _, _ in documents])
    assert used <= bound * 1.02 + 1


def test_quality(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    for (key, text, _, _), (chars, words, kept) in zip(documents, brute.quality([(t, lang) for _, t, lang, _ in documents])):
        r = found[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(text)
        assert math.isclose(r.char_distance, chars, abs_tol=1e-9) and math.isclose(r.word_distance, words, abs_tol=1e-9)
        assert r.kept == kept


def test_quality_keeps_good_documents(spark, sf_dir):
    judged = QUERIES["op4_quality_rules"](spark, sf_dir).where("NOT base_failed")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = {tuple(r)[:2]: r["count"] for r in judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, False), 0) > 0


def test_near_duplicates(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op5_near_duplicates"](spark, sf_dir).collect()}
    prints = [brute.fingerprint(t) for _, t, _, _ in documents]
    numbers = brute.groups(prints)
    least = {}
    for (key, *_), number in zip(documents, numbers):
        least[number] = min(key, least.get(number, key))
    assert {k: (r.fingerprint, r.component_id) for k, r in found.items()} == {
        key: (f"{p:016x}", least[n]) for (key, *_), p, n in zip(documents, prints, numbers)
    }


def test_mixing(spark, sf_dir, documents):
    query = QUERIES["op6_source_mixing"]
    rows = query(spark, sf_dir).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, query(spark, sf_dir).collect()))
    sizes = {d: len(brute.WORD.findall(t or "")) for d, t, _, _ in documents}
    totals = Counter()
    for d, _, _, source in documents:
        totals[source] += sizes[d]
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sources))]
    targets = dict(zip(sources, brute.water_fill([totals[s] for s in sources], weights, 1.5 * sum(totals.values()))))
    taken = Counter()
    for r in rows:
        assert (r.size, r.source_size) == (sizes[r.doc_id], totals[r.source])
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    largest = max(sizes.values())
    assert all(abs(taken[s] - targets[s]) <= largest for s in sources)


def test_wavelet_tokens(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op7_wavelet_tokens"](spark, sf_dir).collect()}
    start = 0
    in_order = sorted(documents)
    for (key, *_), ids in zip(in_order, brute.token_ids([t for _, t, _, _ in in_order])):
        r = found[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, brute.crc(ids + [2]))
        start += len(ids) + 1


def test_personal_data(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op8_personal_data"](spark, sf_dir).collect()}
    for key, text, _, _ in documents:
        spans = brute.personal(text)
        r = found[key]
        assert r.base_sha256 == brute.sha(brute.spans_text(spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert ",".join(base) == brute.spans_text(spans)


def test_language_model(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op9_lm_scoring"](spark, sf_dir).collect()}
    wanted, tokens = brute.language_scores([(d, t) for d, t, _, _ in documents], lm.BACKOFF)
    held = base_sum = score_sum = 0
    for (key, *_), (h, n, known, base, score) in zip(documents, wanted):
        r = found[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        # Quantisation costs at most half a step a token.
        assert abs(r.score - score) <= 0.02 * n + 1e-6
        if h:
            held, base_sum, score_sum = held + n, base_sum + base, score_sum + r.score
    assert held and score_sum > base_sum  # the model is better than single words on texts it has not seen


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [docs]
    for _, function in corpus_pipeline.STAGES:
        from tableloom.staging import stage

        stages.append(stage(function(spark, stages[-1], sf_dir)))
    tables = [[r.asDict() for r in s.collect()] for s in stages]
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert before.columns == after.columns
    # Quality: what the rules keep, as it was.
    verdicts = brute.quality([(r["text"], r["lang"]) for r in tables[0]])
    key = lambda r: r["doc_id"]
    assert sorted(tables[1], key=key) == sorted((r for r, v in zip(tables[0], verdicts) if v[2]), key=key)
    # Near duplicates: the smallest id of each group, as it was.
    best = {}
    for r, number in zip(tables[1], brute.groups([brute.fingerprint(r["text"]) for r in tables[1]])):
        best[number] = min(best.get(number, r), r, key=key)
    assert sorted(tables[2], key=key) == sorted(best.values(), key=key)
    # Personal data: nothing of the base kinds is left, and texts without any stay.
    masked = {r["doc_id"]: r["text"] for r in tables[3]}
    for r in tables[2]:
        spans = brute.personal(r["text"])
        assert masked[r["doc_id"]].count("<email>") >= sum(s[0] == "email" for s in spans) - 1
        if not spans and not any(c.isdigit() for c in r["text"]):
            assert masked[r["doc_id"]] == r["text"]
        for _, a, b in spans:
            assert r["text"][a:b] not in masked[r["doc_id"]]
    # Mixing: copies within the cap, near the targets.
    times = Counter(r["doc_id"] for r in tables[4])
    assert max(times.values()) <= 2
    assert {r["doc_id"]: r for r in tables[4]} == {r["doc_id"]: r for r in tables[3] if r["doc_id"] in times}
    used, bound = check_packing(stages[5].collect(), [(r["doc_id"], r["text"]) for r in tables[4]])
    assert used <= bound * 1.02 + 1
    counted = corpus_pipeline.run(spark, sf_dir)
    assert counted.columns == stages[5].columns and counted.count() == len(tables[5])
