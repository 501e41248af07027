"""Main text of web pages: markup where it says what a block is, a host suffix array where it does not.

A page is cut into blocks, its runs of text between block-level tags. Markup settles most of them:
what stands in a menu, footer, form, advert and the like (by element, role or class) is out, what
stands in the page's article is in. Blocks of pages without an article are open. The token streams of
all pages of a host are concatenated, those of articles and those of open blocks apart, and a suffix
array over them finds the runs of ``LEAST`` or more words, and whole blocks, that another page of the
host has too. Of open blocks these are boilerplate: they are removed and the unique runs stay.

Repetition alone can't judge the inside of an article: sites carry copies of articles, and quoted
passages and licence lines are article text, while a menu or advert may differ on every page. So what
the array finds there is checked against the markup, which puts it back, and is reported as a count.

Hosts of any size: the pages of a host are dealt into parts of bounded size, each with a
suffix array of its own, sorted by prefix doubling to ``LEAST`` words (what lies deeper cannot change
whether two suffixes share so many). Parts of a split host exchange the keys of their groups of
equal prefixes; a key that two parts know is repeated too. First go short keys, sorted and compressed
by ranges; whole keys follow for those that two parts have, so that few rows go twice and all are
compared whole. A line on every page is one key a part.

Defined results: NULL html is an empty page; a NULL url or one without a host belongs to the empty
host, whose pages are no site, so nothing counts as repeated there; rows of one page_id, and rows that
agree in all, are the same page and do not make each other's text boilerplate; NULL ids each are
a page of their own; text that a page cuts off inside a tag is dropped with the tag. Other columns
of the input take no part.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.compact import squeeze_sorted, unsqueeze_sorted
from tableloom.llm.text import text_of

LEAST = 16  # words of a repeated run; a power of two
PART_WORDS = 1_000_000
SPACE = " \t\n\v\f\r"

# Fixed values of HTML: elements without text for readers, without content, and within a line.
RAW = "script style template noscript textarea title svg math iframe object select canvas audio video xmp noembed noframes"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = (
    "a abbr acronym area b bdi bdo big cite code data del dfn em embed font i img input ins kbd label map mark nobr param "
    "q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr"
)
# Elements that are no main text, and those that hold it.
ASIDE = "nav footer aside form menu dialog head button fieldset datalist"
MAIN = "article main"
# Elements whose end tag may be left out: the tags that end them.
CLOSED_BY = {
    "p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul",
    "li": "li",
    "dt": "dt dd",
    "dd": "dt dd",
    "tr": "tr",
    "td": "td th tr",
    "th": "td th tr",
    "option": "option",
}
ROLES = "navigation banner contentinfo complementary search menu menubar dialog alert form"
# Words of class and id names that stand for boilerplate, but not after the words that say what a wrapper has.
NAMES = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notification outbrain pager pagination popup promo promoted recommended related share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription taboola toolbar topbar widget"
)

_RAW, _VOID, _INLINE, _ASIDE, _MAIN = (frozenset(s.split()) for s in (RAW, VOID, INLINE, ASIDE, MAIN))
_CLOSED_BY = {k: frozenset(v.split()) for k, v in CLOSED_BY.items()}
_ROLES, _NAMES = frozenset(ROLES.split()), frozenset(NAMES.split())
_HEADERS, _HAVING = frozenset(("header", "masthead", "banner")), frozenset("has have js no without with".split())

_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?][^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACES = re.compile(f"[{SPACE}]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

IN, OPEN = 0, 1


def _is_aside(name: str, rest: str, article: bool) -> bool:
    """Whether an element is no main text by its name, role or class. A header of an article is."""
    if name in _ASIDE or name == "header" and not article:
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    for match in _ATTRIBUTE.finditer(rest):
        kind = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if kind == "role":
            if value.strip().lower() in _ROLES:
                return True
        elif kind in ("hidden", "aria-hidden"):
            if value.lower() != "false" and (kind == "hidden" or value.lower() == "true"):
                return True
        elif kind in ("class", "id") and any(_says_aside(part, article) for part in value.split()):
            return True
    return False


def _says_aside(name: str, article: bool) -> bool:
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    if words and words[0] in _HAVING:
        return False
    return any(w in _NAMES and not (article and w in _HEADERS) for w in words)


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(IN or OPEN, text) of the page's blocks in page order, those known to be no main text left out."""
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in the article, aside
    article = aside = False
    place, end = 0, len(page)

    def close_block() -> None:
        if pieces:
            text = _SPACES.sub(" ", entities.unescape("".join(pieces))).strip(" ")
            if text:
                blocks.append((IN if article else OPEN, text))
            pieces.clear()

    while place < end:
        at = page.find("<", place)
        tag = _TAG.match(page, at) if at >= 0 else None
        if at < 0 or tag is None:
            stop = end if at < 0 else at + 1
            if not aside:
                pieces.append(page[place:stop])
            place = stop
            continue
        if at > place and not aside:
            pieces.append(page[place:at])
        place = tag.end()
        if tag["name"]:
            name = tag["name"].lower()
            if name in _RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, place)
                place = close.end() if close else end
                continue
            if name not in _INLINE:
                close_block()
                # An element left open may end here, under inline ones that stand in it.
                while (opened := _innermost(stack)) >= 0 and name in _CLOSED_BY.get(stack[opened][0], ()):
                    del stack[opened:]
                    article, aside = stack[-1][1:] if stack else (False, False)
            if name in _VOID or tag["rest"].endswith("/"):
                continue
            aside = aside or _is_aside(name, tag["rest"], article)
            if aside:
                close_block()
            article = article or (not aside and name in _MAIN)
            stack.append((name, article, aside))
        elif tag["end"]:
            name = tag["end"].lower()
            if name not in _INLINE:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    article, aside = stack[-1][1:] if stack else (False, False)
                    break
    close_block()
    return blocks


def _innermost(stack: list[tuple[str, bool, bool]]) -> int:
    return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), -1)


def host_of(url: str | None) -> str:
    match = _HOST.match(url or "")
    return match[1].lower() if match else ""


# ---- the suffix array of a part of a host


def suffix_groups(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array sorted by the first ``depth`` words (a power of two), and every suffix's rank.

    Suffixes of equal rank have ``depth`` words in common, or both end before.
    """
    _, rank = np.unique(words, return_inverse=True)
    step = 1
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def _several(owner: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each element, whether its group has elements of more than one owner."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    low, high = (f.reduceat(owner[order], starts) for f in (np.minimum, np.maximum))
    out = np.zeros(len(group), bool)
    out[order] = np.repeat(low != high, np.diff(np.append(starts, len(group))))
    return out


class _Numbers(dict):
    """Numbers words as they are asked for first."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Streams:
    """The concatenated token streams of some pages of one host."""

    def __init__(self, pages: list[int], blocks: list[list[str]], least: int = LEAST):
        self.least = least
        numbers = _Numbers()
        self.blocks = blocks
        self.words = [[b.split(" ") for b in page] for page in blocks]
        flat: list[int] = []
        owner: list[int] = []
        self.bounds: list[list[tuple[int, int]]] = []
        mark = -1
        for page, page_words in zip(pages, self.words):
            bounds = []
            for block in page_words:
                bounds.append((len(flat), len(flat) + len(block)))
                flat += map(numbers.__getitem__, block)
                flat.append(mark)  # a word of its own, so that no run passes the end of a block
                owner += [page] * (len(block) + 1)
                mark -= 1
            self.bounds.append(bounds)
        self.stream, self.owner = np.array(flat, np.int64), np.array(owner, np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        cuts = [b for page in self.bounds for b in page]
        self.starts, self.ends = np.array(cuts, np.int64).reshape(-1, 2).T
        # Suffixes that hold a whole run, and short blocks, which count as a whole.
        fits = np.zeros(len(flat), bool)
        for start, end in cuts:
            fits[start : max(start, end - least + 1)] = True
        self.heads = np.flatnonzero(fits)
        self.short = np.flatnonzero(self.ends - self.starts < least)
        self.fits = fits
        named = np.zeros(len(flat), np.uint64)
        named[self.stream >= 0] = hashes[self.stream[self.stream >= 0]]
        self.head_keys = self._keys(named, self.heads, np.full(len(self.heads), least))
        self.short_keys = self._keys(named, self.starts[self.short], (self.ends - self.starts)[self.short])

    def _keys(self, named: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        key = lengths.astype(np.uint64)
        for i in range(self.least):
            there = i < lengths
            step = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            key = np.where(there, step + named[np.minimum(starts + i, len(named) - 1)], key)
        return key ^ (key >> np.uint64(29))

    def keys(self) -> np.ndarray:
        """The keys of all groups of equal prefixes and short blocks, for the other parts of the host."""
        return np.unique(np.concatenate([self.head_keys, self.short_keys]))

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each place of the stream, whether it is in a run that another page has, in this part or by the keys ``elsewhere``."""
        known = np.sort(elsewhere.astype(np.uint64, copy=False))

        def outside(keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            return known[at] == keys if len(known) else np.zeros(len(keys), bool)

        repeated = np.zeros(len(self.stream) + 1, np.int64)
        here = np.zeros(len(self.stream), bool)
        order, rank = suffix_groups(self.stream, self.least) if len(self.stream) else (np.zeros(0, int), np.zeros(0, int))
        array = order[self.fits[order]]
        here[array] = _several(self.owner[array], rank[array])
        runs = self.heads[here[self.heads] | outside(self.head_keys)]
        np.add.at(repeated, runs, 1)
        np.add.at(repeated, runs + self.least, -1)
        starts = self.starts[self.short]
        blocks = _several(self.owner[starts], self.short_keys.view(np.int64)) | outside(self.short_keys)
        np.add.at(repeated, starts[blocks], 1)
        np.add.at(repeated, self.ends[self.short][blocks], -1)
        return np.cumsum(repeated)[:-1] > 0

    def unique_runs(self, elsewhere: np.ndarray) -> list[list[str]]:
        """Each page's blocks without its repeated runs."""
        covered = self.repeated(elsewhere)
        out = []
        for words, bounds in zip(self.words, self.bounds):
            kept = (" ".join(w for w, c in zip(b, covered[s:e].tolist()) if not c) for b, (s, e) in zip(words, bounds))
            out.append([text for text in kept if text])
        return out

    def repeated_words(self, elsewhere: np.ndarray) -> list[int]:
        """How many words of each page are in repeated runs."""
        before = np.concatenate([[0], np.cumsum(self.repeated(elsewhere))]).tolist()
        return [sum(before[e] - before[s] for s, e in bounds) for bounds in self.bounds]


# ---- Spark


# What stands together in suffix arrays: articles and open blocks of a host apart.
SITE = ["host", "article"]
HTML_WORD = 6  # bytes of markup and text to a word, for the number of parts


ROW_CHARS = 1 << 20  # text of a host's pages that is compressed as one
SPARE_BITS = 8  # of a short key, beyond what tells the site's words apart


def _parsed(pages: DataFrame, kind: str) -> DataFrame:
    """``pages`` parsed: (host, part, parts, article, keys, urls, pages, blocks), a row for some pages of a part.

    ``blocks`` are those of the article or else those that are open, of all the row's pages, compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows: list[tuple[bool, list[int], list[str]]] = []
            open_rows: dict[tuple, int] = {}
            chars: list[int] = []
            for i, (page, host, part) in enumerate(zip(batch.column("html"), *map(pa.Array.to_pylist, batch.select(["host", "part"]).columns))):
                blocks = page_blocks(page.as_py())
                inside = [text for k, text in blocks if k == IN]
                article = bool(inside) or not blocks
                # No block has a line break or a form feed.
                text = "\n".join(inside or [text for _, text in blocks])
                row = open_rows.get((host, part, article), -1)
                if row < 0 or chars[row] + len(text) > ROW_CHARS:
                    row = open_rows[host, part, article] = len(rows)
                    rows.append((article, [], []))
                    chars.append(0)
                rows[row][1].append(i)
                rows[row][2].append(text)
                chars[row] += len(text)
            taken = pa.array([i for _, places, _ in rows for i in places], pa.int64())
            firsts = pa.array([places[0] for _, places, _ in rows], pa.int64())
            ends = pa.array(np.cumsum([0, *[len(places) for _, places, _ in rows]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(n).take(taken)) for n in ("key", "url", "page")]
            texts = [squeeze("\f".join(t).encode("utf-8", "surrogatepass")) for _, _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n).take(firsts) for n in ("host", "part", "parts")],
                    pa.array([article for article, _, _ in rows], pa.bool_()),
                    *lists,
                    pa.array(texts, pa.binary()),
                ],
                ["host", "part", "parts", "article", "keys", "urls", "pages", "blocks"],
            )

    out = f"host string, part long, parts long, article boolean, keys array<{kind}>, urls array<string>, pages array<long>, blocks binary"
    return pages.select("key", "url", "host", "part", "parts", "page", "html").mapInArrow(run, out)


def _streams(table: pa.Table, least: int) -> Streams:
    return Streams(pc.list_flatten(table.column("pages")).to_pylist(), _blocks(table), least)


def _blocks(table: pa.Table) -> list[list[str]]:
    import zstandard

    spread = zstandard.ZstdDecompressor().decompress
    rows = (spread(b.as_py()).decode("utf-8", "surrogatepass") for b in table.column("blocks"))
    return [text.split("\n") if text else [] for row in rows for text in row.split("\f")]


def _dealt(pages: DataFrame, key: str, url: str, html: str, part_words: int) -> DataFrame:
    """(key, url, html, host, part, parts, page): every page's part of its host; the pages of one id stay together."""
    address = F.col(f"`{url}`").cast("string")
    narrow = pages.select(
        F.col(f"`{key}`").alias("key"),
        address.alias("url"),
        F.coalesce(F.lower(F.regexp_extract(address, _HOST.pattern, 1)), F.lit("")).alias("host"),
        text_of(F.col(f"`{html}`")).alias("html"),
    ).withColumn("row", F.monotonically_increasing_id())
    hosts = narrow.where("host <> ''").groupBy("host")
    hosts = hosts.agg(F.ceil(F.sum(F.octet_length("html")) / (HTML_WORD * part_words)).alias("parts"))
    # Hosts of more than a part's size: one row for each such size of input at most.
    dealt = narrow.join(F.broadcast(hosts.where("parts > 1")), "host", "left").fillna(1, "parts")
    # The empty host is no site: each of its pages stands alone.
    page = F.when(F.col("key").isNull(), F.concat(F.lit("?"), F.col("row").cast("string"))).otherwise(F.col("key").cast("string"))
    alone = F.when(F.col("host") == "", F.xxhash64(page)).otherwise(F.pmod(F.xxhash64(page), F.col("parts")))
    return dealt.withColumns({"part": alone, "page": F.xxhash64(page)})


_KNOWN = "host string, article boolean, part long, bucket long, found binary"
_SHARED = "host string, article boolean, part long, found binary"


def _short(keys: np.ndarray, parts: int, part_words: int) -> np.ndarray:
    """The first bits of keys: as many as tell all the site's apart, and some to spare. No more than 64, no less than 32."""
    return keys >> np.uint64(64 - max(32, min(64, SPARE_BITS + (parts * part_words).bit_length())))


def _buckets(site: pa.Table, keys: np.ndarray, found: np.ndarray) -> pa.Table:
    """Rows of a part for the tasks that compare it with the site's others: ``found``, by ranges of the sorted keys."""
    host, article, part, parts = (site.column(n)[0].as_py() for n in (*SITE, "part", "parts"))
    bucket = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    asked, starts = np.unique(bucket, return_index=True)
    pieces = [squeeze_sorted(np.unique(piece)) for piece in np.split(found, starts[1:])] if len(found) else []
    columns = [pa.array([v] * len(pieces), k) for v, k in ((host, pa.string()), (article, pa.bool_()), (part, pa.int64()))]
    columns += [pa.array(asked.astype(np.int64)), pa.array(pieces, pa.binary())]
    return pa.table(columns, names=[*SITE, "part", "bucket", "found"])


def _in_several(known: DataFrame) -> DataFrame:
    """(host, article, part, found): of each part's numbers those that another part of the site has too."""

    def compare(table: pa.Table) -> pa.Table:
        pieces = [unsqueeze_sorted(f.as_py()) for f in table.column("found")]
        numbers, times = np.unique(np.concatenate(pieces), return_counts=True)
        several = numbers[times > 1]
        found = [piece[np.isin(piece, several, assume_unique=True)] for piece in pieces]
        some = table.select([*SITE, "part"]).append_column("found", pa.array([squeeze_sorted(f) for f in found], pa.binary()))
        return some.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    return known.groupBy(*SITE, "bucket").applyInArrow(compare, _SHARED)


def _found(shared: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[unsqueeze_sorted(f.as_py()) for f in shared.column("found")]])


def _short_keys(parts: DataFrame, least: int, part_words: int) -> DataFrame:
    """The short keys of every part of a split site, sorted and compressed: two bytes or so to a word.

    All pages go in, as the parts are then shuffled once for this, for the keys and for their own arrays.
    """

    def short(table: pa.Table) -> pa.Table:
        n = table.column("parts")[0].as_py()
        keys = _streams(table, least).keys() if n > 1 else np.zeros(0, np.uint64)
        return _buckets(table, keys, _short(keys, n, part_words))

    return parts.groupBy(*SITE, "part").applyInArrow(short, _KNOWN)


def _repeats(parts: DataFrame, least: int, part_words: int) -> DataFrame:
    """(host, article, part, found): the keys that split sites' other parts have in common with each part.

    Only keys whose short forms two parts have are exchanged and compared whole.
    """

    def whole(table: pa.Table, shared: pa.Table) -> pa.Table:
        keys = np.zeros(0, np.uint64)
        if shared.num_rows:
            keys = _streams(table, least).keys()
            keys = keys[np.isin(_short(keys, table.column("parts")[0].as_py(), part_words), _found(shared))]
        return _buckets(table, keys, keys)

    candidates = _in_several(_short_keys(parts, least, part_words)).groupBy(*SITE, "part")
    return _in_several(parts.groupBy(*SITE, "part").cogroup(candidates).applyInArrow(whole, _KNOWN))


def main_text(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """(key, url, text, by_markup, n_repeated) of every page, the key in its own type.

    ``by_markup`` is false where the page has no article, so that its repeated runs are gone;
    ``n_repeated`` is how many words of the page's blocks the site's array found on another of its pages.
    """
    if least & (least - 1) or least < 2:
        raise ValueError("least must be a power of two")
    kind = pages.schema[key].dataType.simpleString()
    parts = _parsed(_dealt(pages, key, url, html, part_words), kind)
    out = f"key {kind}, url string, text string, by_markup boolean, n_repeated long"

    def judge(table: pa.Table, shared: pa.Table) -> pa.Table:
        names = ["key", "url", "text", "by_markup", "n_repeated"]
        streams = _streams(table, least)
        elsewhere = _found(shared)
        article = table.column("article")[0].as_py()
        texts = streams.blocks if article else streams.unique_runs(elsewhere)
        columns = [pc.list_flatten(table.column(n)) for n in ("keys", "urls")]
        columns += [pa.array([" ".join(b) for b in texts], pa.string()), pa.array([article] * len(texts), pa.bool_())]
        return pa.table([*columns, pa.array(streams.repeated_words(elsewhere), pa.int64())], names=names)

    left = parts.groupBy(*SITE, "part")
    right = _repeats(parts, least, part_words).groupBy(*SITE, "part")
    judged = left.cogroup(right).applyInArrow(judge, out)
    return judged.select(F.col("key").alias(key), F.col("url").alias(url), "text", "by_markup", "n_repeated")
