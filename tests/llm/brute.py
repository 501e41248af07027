"""Plain Python versions of the operators, over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(texts):
    return [e.ids for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=2):
    """Group number of each fingerprint, by comparing all of them."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(max(0, len(words) - 4))]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines, repeated = set(), 0
    for line in text.split("\n"):
        repeated += bool(WORD.search(line)) and line in lines
        lines.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:!?'\"()-", "#*$%&|<>")


def class_of(c):
    if ord(c) > 127:
        return len(CLASSES) + 1
    return next((i for i, known in enumerate(CLASSES) if c in known), len(CLASSES))


def distance(p, q):
    """Jensen-Shannon distance of two counters."""
    n, m = sum(p.values()) or 1, sum(q.values()) or 1
    total = 0.0
    for key in p.keys() | q.keys():
        a, b = p[key] / n, q[key] / m
        total += sum(x / 2 * math.log2(x / ((a + b) / 2)) for x in (a, b) if x)
    return math.sqrt(max(0.0, min(1.0, total)))


def quality(rows, chars=0.3, words=0.55, least=(400, 50), common=200):
    """(char distance, word distance, kept) of (text, lang) rows."""
    by_class, by_word = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        by_class[lang].update(map(class_of, text or ""))
        by_word[lang].update(WORD.findall(text or ""))
    references = []
    for lang in by_word:
        top = sorted(by_word[lang].items(), key=lambda e: (-e[1], e[0].encode()))[:common]
        if top:
            known = Counter(dict(top))
            known[None] = sum(by_word[lang].values()) - sum(known.values())
            references.append((by_class[lang], known))
    out = []
    for text, _ in rows:
        text = text or ""
        found = WORD.findall(text)
        c = w = 0.0
        if references:
            mine = Counter(map(class_of, text))
            c = min(distance(mine, r[0]) for r in references)
            w = min(distance(Counter(x if x in r[1] else None for x in found), r[1]) for r in references)
        failed = quality_counts(text)[-1]
        odd = (len(text) >= least[0] and c > chars) or (len(found) >= least[1] and w > words)
        out.append((c, w, not failed and not odd))
    return out


def shingles(text, size=5):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def alike_groups(texts, share=(4, 5)):
    """A number per text: groups linked by pairs that share 4/5 of their five-word shingles, by all pairs."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if (not one and not sets[j]) or (both and share[1] * both >= share[0] * (len(one) + len(sets[j]) - both)):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match)


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def personal(text):
    """Spans of the base kinds, by start and kind."""
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, check) in enumerate(PERSONAL)
        for m in re.finditer(pattern, text or "")
        if check(m[0])
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def water_fill(sizes, weights, budget, cap=2.0):
    """Targets by clamping and sharing again."""
    clamped = set()
    while True:
        left = budget - sum(cap * sizes[i] for i in clamped)
        weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        share = [cap * s if i in clamped else w * left / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i, s in enumerate(share) if i not in clamped and s > cap * sizes[i]}
        if not above:
            return share
        clamped |= above
        if len(clamped) == len(sizes):
            return [cap * s for s in sizes]


def language_scores(rows, backoff):
    """(key, text) rows to {place: (held, n, known, base, score)}, N: a bigram model in dictionaries."""
    texts = [WORD.findall(lower(t or "")) + [" "] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows]
    ones, pairs = Counter(), Counter()
    for words, h in zip(texts, held):
        if not h:
            ones.update(words)
            pairs.update(zip([" "] + words[:-1], words))
    n, v = sum(ones.values()), len(ones)
    p = lambda w: (ones[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for words, h in zip(texts, held):
        base = sum(math.log10(p(w)) for w in words)
        score = sum(
            math.log10((pairs[u, w] + backoff * p(w)) / (ones[u] + backoff)) for u, w in zip([" "] + words[:-1], words)
        )
        out.append((h, len(words), sum(ones[w] > 0 for w in words), base, score))
    return out, n
