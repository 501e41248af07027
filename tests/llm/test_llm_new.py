"""HTML extraction, phrase collocations and periodic runs: brute force, edges and properties."""

import hashlib
import html as entities
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.llm import html, lm, phrases, runs, tokens
from tableloom.llm.queries import QUERIES
from tableloom.llm.text import LOWER_TABLE, lower_ascii
from tests.llm import brute


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# ---- 11 html


def article_text(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", inside)
    texts = (re.sub(r"[ \t\n\v\f\r]+", " ", entities.unescape(re.sub(r"</?b>", "", b))).strip(" ") for b in blocks)
    return " ".join(t for t in texts if t)


def test_every_page_gives_its_article(spark, sf_dir):
    found = {r.page_id: r for r in QUERIES["op11_html_extraction"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        r = found[p.page_id]
        assert (r.url, r.text, r.n_chars, r.by_markup) == (p.url, article_text(p.html), len(r.text), True)


PAGE = """<!DOCTYPE html><HTML><head><title>T</title></head><body class="has-sidebar">
<header><a href=/>Site</a></header><div id="mainNav"><ul><li>Home<li>News</ul></div><!-- <p>no</p> -->
<script>if (a < b) document.write("<p>no</p>");</script><div role=search>find</div>
<main><header><h1>Head &amp;amp; line</h1></header><p>one <b>t</b>wo&nbsp;&#x41;&lt;b&gt;<p>three
<img alt="a > b" src=x>four<br/>five<div class="share-buttons"><p>share <div>it</div></div>
<aside>more</aside><table><tr><td>c1<td>c2</table><form><input value="x">send</form><style>p{}</style>
<section id=comments><article class="comment">first!</article></section>3 < 4 &copy 5</main>
<div class="cookieNotice">cookies</div><footer>foot</footer></body>"""


def test_markup_decides():
    assert [t for _, t in html.page_blocks(PAGE)] == ["Head &amp; line", "one two\xa0A<b>", "three four", "five", "c1", "c2", "3 < 4 © 5"]
    assert {k for k, _ in html.page_blocks(PAGE)} == {html.IN}
    for broken in ("", "<", "</", "<!--", "<!-- a", "<p", '<p title="x', "</p>text", "<script>", "<article><p>a", "a<b"):
        html.page_blocks(broken)
    assert html.page_blocks("<article><p>a") == [(html.IN, "a")]
    assert html.page_blocks("<nav>x</nav>y<article> </article>") == [(html.OPEN, "y")]
    assert html.host_of("https://u:p@Ex.org:80/a?b") == "ex.org" and html.host_of(None) == html.host_of("ex.org/a") == ""


def unique_runs(pages, least):
    """Words that no other page has within a run of ``least`` words of a block, or as a whole shorter block."""
    seen = {}
    for page, blocks in pages:
        for b in blocks:
            w = b.split(" ")
            for i in range(max(1, len(w) - least + 1)):
                seen.setdefault(tuple(w[i : i + least]), set()).add(page)
    out = []
    for page, blocks in pages:
        kept = []
        for b in blocks:
            w = b.split(" ")
            gone = set()
            for i in range(max(1, len(w) - least + 1)):
                if len(seen[tuple(w[i : i + least])]) > 1:
                    gone.update(range(i, i + least))
            text = " ".join(x for i, x in enumerate(w) if i not in gone)
            kept += [text] if text else []
        out.append(kept)
    return out


def open_pages(seed, n):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 4, 7, 20]))) for _ in range(12)]
    return [
        (page, [rng.choice(lines) if rng.random() < 0.5 else " ".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(6)])
        for page in range(n)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_finds_the_repeats(seed):
    pages = open_pages(seed, 9)
    found = html.Streams([p for p, _ in pages], [b for _, b in pages], 4).unique_runs(np.zeros(0, np.int64))
    assert found == unique_runs(pages, 4)


@pytest.mark.parametrize("part_words", [40, 10**6])
def test_open_pages_lose_what_their_host_repeats(spark, part_words):
    pages = open_pages(7, 30)
    body = lambda blocks: "".join(f"<div>{b}</div>" for b in blocks)
    table = [(p, f"http://h/{p}", body(b), "x") for p, b in pages]
    table += [(p, f"http://other{p}/", body(b), "x") for p, b in pages[:3]]  # other hosts: nothing repeats
    table += [(100, "http://h/100", body(pages[0][1][:1]) + "<article>a b c d</article>", "x")]
    df = spark.createDataFrame(table, "page_id long, url string, html string, host string").repartition(3)
    found = {r.url: r for r in html.main_text(df, least=4, part_words=part_words).collect()}
    wanted = unique_runs(pages, 4)
    assert [found[f"http://h/{p}"].text for p, _ in pages] == [" ".join(b) for b in wanted]
    assert [found[f"http://other{p}/"].text for p, _ in pages[:3]] == [" ".join(b) for _, b in pages[:3]]
    assert found["http://h/100"].text == "a b c d" and found["http://h/100"].by_markup
    assert len(found) == len(table)


@pytest.mark.parametrize("part_words", [40, 10**6])
def test_articles_pass_the_array_too(spark, part_words):
    """Articles stay whole, and the words that other articles of the host hold are counted."""
    pages = open_pages(3, 20)
    table = [(p, f"http://h/{p}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") for p, blocks in pages]
    table += [(50, "http://other/", table[0][2]), (51, "http://h/51", ""), (52, None, table[0][2]), (53, None, table[0][2])]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r for r in html.main_text(df, least=4, part_words=part_words).collect()}
    assert len(found) == len(table) and all(r.by_markup for r in found.values())
    for (page, blocks), kept in zip(pages, unique_runs(pages, 4)):
        words = lambda texts: sum(len(t.split(" ")) for t in texts)
        assert (found[page].text, found[page].n_repeated) == (" ".join(blocks), words(blocks) - words(kept))
    assert sum(found[p].n_repeated for p, _ in pages) > 0
    assert [found[p].n_repeated for p in (50, 51, 52, 53)] == [0, 0, 0, 0] and found[51].text == ""


def test_parts_exchange_few_bytes_a_word(spark):
    """Parts of a split site exchange short keys, packed; only those that two parts have go whole."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    texts += [f"{rng.randrange(10**6)} {texts[0][:200]} {rng.randrange(10**6)}" for _ in range(3)]
    df = spark.createDataFrame([(i, "http://h/", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    parts = html._parsed(html._dealt(df, "page_id", "url", "html", 5000), "long")
    assert parts.select("part").distinct().count() > 3
    short = html._short_keys(parts, 16, 5000).selectExpr("sum(octet_length(found)) AS n").first().n
    assert short < 4 * sum(len(t.split(" ")) for t in texts)
    shared = {r.part: html.unsqueeze_sorted(r.found) for r in html._repeats(parts, 16, 5000).groupBy("part").agg(F.min("found").alias("found")).collect()}
    assert len(shared) > 1 and all(0 < len(keys) < 20 for keys in shared.values())


# ---- 9 language model


def test_lower_ascii_is_quick_on_other_letters():
    odd = "AZ[`az{ \u00c9\u0130\u212a \ud800 \U0001f600"
    assert lower_ascii(odd) == odd.translate(LOWER_TABLE) and lower_ascii("AbZ@[") == "abz@["
    text = "The \u00e9t\u00e9 of Words " * 50_000

    def seconds(lower):
        start = time.perf_counter()
        lower(text)
        return time.perf_counter() - start

    assert min(seconds(lower_ascii) for _ in range(3)) * 3 < min(seconds(lambda t: t.translate(LOWER_TABLE)) for _ in range(3))


def test_pairs_of_many_blocks_are_counted_once():
    asked, seen = np.array([3, 7, 3, 9, 7], np.uint64), np.array([2, 0, 5, 0, 0], np.uint32)
    distinct, which, sums = lm._counted(asked, seen)
    assert (distinct.tolist(), sums.tolist()) == ([3, 7, 9], [7, 0, 0]) and (distinct[which] == asked).all()


def test_pages_edges(spark):
    schema = "page_id string, url string, html string, host long, text long, open long, part long"
    table = [
        ("a", "http://h/1", "<p>same words here</p>"),
        ("a", "http://h/2", "<p>same words here</p>"),  # the same page: no repeat of another
        ("a", "http://h/2", "<p>same words here</p>"),
        ("b", None, "<p>no host</p>"),
        ("c", None, "<p>no host</p>"),
        (None, "http://k/", "<p>twice</p><p>own</p>"),
        (None, "http://k/", "<p>twice</p>"),
        ("d", "http://h/3", None),
        ("e", "http://h/4", "<article>" + "<p>w" * 50_000),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in table], schema)
    found = rows(html.main_text(df).select("page_id", "url", "text"))
    assert found == Counter(
        [
            ("a", "http://h/1", "same words here"),
            ("a", "http://h/2", "same words here"),
            ("a", "http://h/2", "same words here"),
            ("b", None, "no host"),
            ("c", None, "no host"),
            (None, "http://k/", "own"),
            (None, "http://k/", ""),
            ("d", "http://h/3", ""),
            ("e", "http://h/4", " ".join("w" * 50_000)),
        ]
    )
    assert html.main_text(df.limit(0)).count() == 0


# ---- 12 phrases


def frequent(docs, least, longest):
    counts, totals = Counter(), Counter()
    for text, lang in ((t, "und" if g is None else g) for t, g in docs):
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", brute.lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, " ".join(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return {k: f for k, f in counts.items() if f >= least}, totals


def collocations(docs, least, longest, top):
    f, totals = frequent(docs, least, longest)
    best = {}
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        parts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], k) for k in range(1, len(w))]
        score, k, l, r = min((1000 * a * totals[lang] // (l * r), k, l, r) for l, r, k in parts)
        longer = (f[lang, p] for g, p in f if g == lang and len(p) > len(phrase) and f" {phrase} " in f" {p} ")
        if not any(100 * b >= 100 * a for b in longer):
            best.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, l, r, totals[lang], score, k))
    return {(lang, i + 1, *row[3:]) for lang, found in best.items() for i, row in enumerate(sorted(found)[:top])}


LETTERS = "a b c Dd é x.y , ! \t \n\r \x0b a\x1cb".split(" ")


@pytest.mark.parametrize("seed", range(3))
def test_collocations_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(" ".join(rng.choices(LETTERS, k=rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    docs += [(None, "en"), ("", None), ("z " * 3000, "en"), ("only words", "")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "text string, lang string, phrase long").repartition(4)
    found = phrases.collocations(df, least=5, top=40)
    assert {tuple(r) for r in found.collect()} == collocations(docs, 5, 5, 40)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_small_memory_loses_nothing(spark, monkeypatch):
    """Tasks that hand on early, and bitmaps that are full, change no count."""
    rng = random.Random(5)
    docs = [(" ".join(rng.choices("abcdefghijkl", k=80)), rng.choice("pq")) for _ in range(50)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    for name in ("HELD", "HELD_PHRASES", "HELD_WORDS"):
        monkeypatch.setattr(phrases, name, 20)
    monkeypatch.setattr(phrases, "FEW_LANGUAGES", 1)
    monkeypatch.setattr(phrases, "PENDING", 100)
    monkeypatch.setattr(phrases, "GROUP_BYTES", 300)
    monkeypatch.setattr(phrases, "BITS", 6)
    monkeypatch.setattr(phrases, "SLICE_BITS", 4)
    found = {(r.lang, r.phrase): r.f for r in phrases.frequent_phrases(df, least=6).where("words > 0").collect()}
    assert found == frequent(docs, 6, 5)[0]


@given(keys=st.lists(st.integers(0, 30), max_size=300), cuts=st.integers(1, 6), least=st.integers(2, 30))
@settings(max_examples=80, deadline=None)
def test_summaries_keep_every_frequent_key(keys, cuts, least):
    capacity = len(keys) // least + 1
    parts = []
    for i in range(cuts):
        part = phrases.Summary(capacity, least)
        for key in keys[i::cuts]:
            part.add(np.array([key], np.uint64), np.array([1]))
        parts.append(part)
    whole = phrases.Summary(capacity, least)
    for key in keys:
        whole.add(np.array([key], np.uint64), np.array([1]))
    wanted = {k for k, n in Counter(keys).items() if n >= least}
    assert len(whole.keys) <= capacity and whole.taken < least
    assert wanted <= set(whole.survivors().tolist())
    merged = parts[0]
    for part in parts[1:]:
        merged.merge(part)
    assert merged.taken >= least or wanted <= set(merged.survivors().tolist())


# ---- 13 runs


def all_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out)


@st.composite
def looping(draw):
    w = draw(st.lists(st.integers(0, draw(st.integers(0, 5))), max_size=60))
    for _ in range(draw(st.integers(0, 2))):
        unit = draw(st.lists(st.integers(0, 3), min_size=1, max_size=25))
        at = draw(st.integers(0, len(w)))
        w[at:at] = (unit * 8)[: draw(st.integers(1, 120))]
    return w


@given(texts=st.lists(looping(), max_size=4), least=st.sampled_from([2, 12]), data=st.data())
@settings(max_examples=120, deadline=None)
def test_runs_against_brute_force(texts, least, data):
    found = runs.runs_of([np.array(t, np.int64) for t in texts], least)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [all_runs(t, least) for t in texts]
    # Word by word or in pieces: the same runs, and each square is reported once.
    for t in texts[:1]:
        catchers, squares, at = runs.Catchers(least), [], 0
        while at < len(t):
            step = data.draw(st.sampled_from([1, 1, 3, 20]))
            squares += catchers.append(np.array(t[at : at + step], np.int64))
            at += step
        assert [tuple(r) for r in catchers.runs().tolist()] == all_runs(t, least)
        assert len(squares) == len(set(squares)) and {(s, p) for s, _, p in all_runs(t, least)} <= set(squares)


def judged(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str("" if key is None else key).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return key, len(found), *longest, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert [found[d.doc_id] for d in docs] == [judged(d.doc_id, d.text) for d in docs]
    assert sum(f[1] > 0 for f in found.values()) > 20


def test_runs_edges(spark):
    table = [(None, None), (1, ""), (2, "\t \n"), (3, "w " * 3000), (3, "w " * 3000), (None, "a b\x0ba b " * 9), (4, "é ü " * 6 + "x")]
    df = spark.createDataFrame([(*r, 0, 0) for r in table], "doc_id long, text string, key long, n_runs long").repartition(3)
    out = runs.periodic_runs(df, rewrite=runs.with_loops).withColumn("text", F.sha2("text", 256))
    assert rows(out) == Counter(judged(*r) for r in table)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    assert runs.periodic_runs(spark.createDataFrame([("k", "b " * 20)], "id string, body string"), "id", "body").first()[:2] == ("k", 1)


# ---- 2, 7 tokens and 9 look-up


def test_added_tokens_get_their_ids():
    tool, plain = tokens.encoder(tokens.default_vocabulary()), brute.tokenizer()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "<|endoftext|> y  z", "<|endoftext|><|endoftext|>", "no token", ""]
    wanted = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in tool.encode(texts)] == wanted and [50256] in wanted


@given(data=st.data(), n=st.sampled_from([1, 2, 7, 511, 512, 513, 1024, 1536]), top=st.sampled_from([0, 1, 3, 512, 5000, 10**9, 2**50]))
@settings(max_examples=80, deadline=None)
def test_successors_on_the_coded_level(data, n, top):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    values = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
    level = lm.EliasFano.build(values)
    assert (level.get_many(np.arange(n)) == values).all() and (level.decode() == values).all()
    asked = np.concatenate([values, rng.integers(0, top + 3, 50).astype(np.uint64), np.array([0, top + 1, 2 * top + 5], np.uint64)])
    start = rng.integers(0, n + 1, len(asked))
    end = np.minimum(n, start + rng.integers(0, n + 1, len(asked)))
    wanted = [a + int(np.searchsorted(values[a:b], v)) for v, a, b in zip(asked, start, end)]
    assert level.successors(asked, start, end).tolist() == wanted


def test_pairs_are_found_in_a_shard():
    rng = np.random.default_rng(3)
    first, second = rng.zipf(1.4, 4000) % 300, rng.zipf(1.4, 4000) % 5000
    pairs = np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))
    shard = lm.Shard.build(pairs, rng.normal(size=len(pairs)), 5000)
    asked = np.concatenate([pairs, pairs ^ np.uint64(1), pairs ^ np.uint64(1 << 32), np.array([2**62], np.uint64)])
    at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
    wanted = np.where(pairs[at] == asked, shard.codes[at].astype(int) + 1, 0)
    found = shard.find(asked)
    assert (found == wanted).all()
    assert [shard.find_one(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in asked[::97]] == found[::97].tolist()


def test_words_are_looked_up_once_a_batch():
    tool, plain = tokens.Encoder(tokens.default_vocabulary()), brute.tokenizer()
    asked = Counter()

    class Words(dict):
        def get(self, word):
            asked[word] += 1
            return super().get(word)

    tool.words = Words()
    texts = ["x" + " one two. one\nthree" * 50, "", "  odd  spaces ", "two. one x"] * 3
    assert [i.tolist() for i in tool.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and max(asked.values()) == 1
