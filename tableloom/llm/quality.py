"""Quality rules: base rules, and how far a text's statistics lie from its language's.

Two histograms are taken of each text: shares of character classes, and shares of the common words
of a language (with one bin for all other words). A language's reference is the same histogram
over all documents of that language; its common words are its 200 most frequent. Only labels that
name a language make references, and of those each histogram only if it looks like prose of some
language, so junk that carries a label of its own pardons nothing. A text is
held against the reference that is nearest, so a wrong label harms no one, by the
Jensen-Shannon distance (base 2, 0 to 1). Short texts vary by chance, so a distance counts
only from a number of characters or words on, and the limits lie far outside what
ordinary prose of any of the languages shows.

Counts for the references are combined in the task that reads the texts and summed by Spark.
Every language has its reference. Those of the 64 with most words go to every task, which is a bound
whatever the input; a text of another language meets its own as well, by a join on the label. A text
that all these would reject is then held against every other reference, 64 at a time, whatever its
label, so a verdict does not depend on how many languages the table has. (Distances only fall as
references are added, so a text that passes needs no more of them; its distances are to the nearest
reference it was held against.)

Defined results: NULL text has no words; a NULL or blank label, one without a letter and one that
says the language is not known names none; in a table without references every text that passes
the base rules is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.llm.text import WORD, free_names
from tableloom.staging import stage, stage_unless_empty

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
COMMON = 200  # words per reference
LANGUAGES = 64  # references a task holds texts against at a time
GUARD_CHARS, GUARD_WORDS = 400, 50
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.55
# What a histogram of prose shows: shares of characters, and of words.
LEAST_LETTERS, MOST_SYMBOLS = 0.6, 0.05
MOST_BARE, LEAST_COMMON = 0.1, 0.1  # words without a letter; the common words together,
COMMON_FROM = 4_000  # which counts from so many words on
NO_LANGUAGE = r"^(und|mul|mis|zxx|unknown|undefined|undetermined|other|none|null|n/a)([-_].*)?$"
_FLUSH = 200_000  # partial counts kept by a task before they are handed on

# ASCII characters of each class; a lead byte stands for any other character.
CLASSES = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    " ",
    "\n",
    ".,;:!?'\"()-",
    "#*$%&|<>",
)
_OTHER_ASCII, _BEYOND = len(CLASSES), len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2


def _class_matrix() -> np.ndarray:
    matrix = np.zeros((256, N_CLASSES))
    matrix[:128, _OTHER_ASCII] = 1
    for number, characters in enumerate(CLASSES):
        for c in characters:
            matrix[ord(c)] = 0
            matrix[ord(c), number] = 1
    matrix[0xC0:, _BEYOND] = 1  # bytes 0x80 to 0xBF continue a character and count for none
    return matrix


def class_counts(text: str, matrix: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.bincount(data, minlength=256) @ matrix


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of ``q`` from ``p``; all are counts, turned into shares here."""
    p, q = p / max(p.sum(), 1), q / np.maximum(q.sum(axis=-1, keepdims=True), 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=-1)
        two = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=-1)
    return np.sqrt(np.clip((one + two) / 2, 0, 1))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five found twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*[words[i:] for i in range(WINDOW)]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # covered: words before this place are counted or passed
    for place, window in enumerate(windows):
        if counts[window] > 1:
            total += place + WINDOW - max(place, covered)
            covered = place + WINDOW
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    total = 0
    for line in lines:
        if line in seen:
            total += re.search(WORD, line) is not None
        seen.add(line)
    return total


def names_language(label: Column) -> Column:
    """False for NULL."""
    plain = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return F.regexp_like(plain, F.lit(r"\p{L}")) & ~F.regexp_like(plain, F.lit(NO_LANGUAGE))


def _sound(classes: bool) -> Column:
    """Whether the histogram of classes (else of words) in the counts ``top`` of a label looks like prose."""

    def total(chosen: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("top", chosen), F.lit(0).cast("long"), lambda a, e: a + e["n"])

    in_class = lambda e: e["is_class"] & (e["word"] != " words")
    of = lambda *numbers: total(lambda e: e["word"].isin(*[f" {i}" for i in numbers]))
    if classes:
        n = total(in_class)
        return (of(0, 1, _BEYOND) >= LEAST_LETTERS * n) & (of(CLASSES.index("#*$%&|<>")) <= MOST_SYMBOLS * n)
    n = total(lambda e: e["word"] == " words")
    bare = total(lambda e: ~e["is_class"] & ~F.regexp_like(e["word"], F.lit(r"\p{L}")))
    common = total(lambda e: ~e["is_class"])
    return (bare <= MOST_BARE * n) & ((n < COMMON_FROM) | (common >= LEAST_COMMON * n))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[tuple], DataFrame | None]:
    """References of the languages with most words, and a table (lang, top, classes, words) of the others, if any.

    A reference is the class counts, the places of the common words, and their counts (last: all
    others). None stands for a histogram that does not look like prose.
    """
    label = F.col(f"`{lang}`")
    narrow = docs.where(names_language(label)).select(label.cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    matrix = _class_matrix()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        counts: Counter = Counter()
        parts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, part in parts.items() for word, n in part.items()]
            rows += [(lang, f" {kind}", n) for (lang, kind), n in counts.items()]
            parts.clear()
            counts.clear()
            langs, words, numbers = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(map(int, numbers), pa.int64())], ["lang", "word", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                words = find(text)
                parts.setdefault(lang, Counter()).update(words)
                counts[lang, "words"] += len(words)
                for kind, n in enumerate(class_counts(text, matrix)):
                    counts[lang, kind] += int(n)
                if sum(map(len, parts.values())) > _FLUSH:
                    yield flush()
        yield flush()

    # A space cannot begin a word, so it marks the rows of character classes and of totals.
    sums = narrow.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang", "is_class").orderBy(F.col("n").desc(), "word")
    top = (
        sums.withColumn("is_class", F.col("word").startswith(" "))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= COMMON)
    )
    # One row per language; written, as it is read twice.
    each = stage(
        top.groupBy("lang")
        .agg(F.collect_list(F.struct("is_class", "word", "n")).alias("top"), F.sum(F.when(~F.col("is_class"), F.col("n"))).alias("common"))
        .withColumns({"classes": _sound(True), "words": _sound(False)})
        .where("common > 0 AND (classes OR words)"),
        "references",
    )
    rows = each.orderBy(F.col("common").desc(), "lang").limit(LANGUAGES + 1).collect()
    shared = rows[:LANGUAGES]
    others = each.where(~F.col("lang").isin(*[r["lang"] for r in shared])) if len(rows) > LANGUAGES else None
    return [_reference(row) for row in shared], others


def _reference(row) -> tuple:
    classes = np.zeros(N_CLASSES)
    words: dict[str, int] = {}
    numbers: list[int] = []
    total = 0
    for entry in sorted(row["top"], key=lambda e: (-e["n"], e["word"])):
        if entry["word"] == " words":
            total = entry["n"]
        elif entry["is_class"]:
            classes[int(entry["word"])] = entry["n"]
        else:
            words[entry["word"]] = len(numbers)
            numbers.append(entry["n"])
    counts = np.array([*numbers, total - sum(numbers)], float)
    return classes if row["classes"] else None, words, counts if row["words"] else None, row["lang"]


_FEATURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "char_distance": "double",
    "word_distance": "double",
    "base_failed": "boolean",
    "kept": "boolean",
}
_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the counts, both distances and the verdict.

    A new column whose name is taken gets an underscore in front.
    """
    known, others = references(docs, text, lang)
    rest = docs.columns if carry is None else carry
    names = [f"c{i}" for i in range(len(rest))]
    body = names[rest.index(text)] if text in rest else "text"
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)]
    if body == "text":
        columns.append(F.col(f"`{text}`").alias("text"))
    narrow = docs.select(*columns)
    given = narrow
    if others is not None:
        # Languages that all texts are held against, however frequent, do not enter the join.
        label = F.col(f"`{lang}`").cast("string")
        apart = names_language(label) & ~label.isin(*[k[3] for k in known])
        rare = docs.where(apart).select(*columns, label.alias("lang")).join(
            others.select("lang", F.struct("lang", "top", "classes", "words").alias("own")), "lang", "left"
        )
        none = F.lit(None).cast(rare.schema["own"].dataType)
        given = docs.where(~apart).select(*columns, none.alias("own")).unionByName(rare.drop("lang"))
    others_given = others is not None
    carried = narrow.columns if others_given else names
    matrix = _class_matrix()
    near = _Nearest(known)

    def judge(text: str, find, own: tuple = (None, None, None)) -> tuple:
        words = find(text)
        n_words = len(words)
        repeats = repeated_words(words)
        histogram = class_counts(text, matrix)
        by_class, by_word = near.distances(histogram, words, own)
        by_class, by_word = (d if d < math.inf else 0.0 for d in (by_class, by_word))
        failed = n_words < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
        return (
            n_words,
            sum(map(len, words)),
            int(histogram[CLASSES.index("#*$%&|<>")]),
            repeated_lines(text),
            repeats,
            by_class,
            by_word,
            failed,
            not failed and not _odd(int(histogram.sum()), by_class, n_words, by_word),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        cache: dict[str, tuple] = {}

        def own_of(value: pa.StructScalar) -> tuple:
            if not value.is_valid:
                return None, None, None
            label = value["lang"].as_py()
            if label not in cache:
                if len(cache) >= LANGUAGES:
                    cache.clear()
                cache[label] = _reference(value.as_py())
            return cache[label]

        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(body))
            if others_given:
                rows = [judge(t, find, own_of(o)) for t, o in zip(texts, batch.column("own"))]
            else:
                rows = [judge(t, find) for t in texts]
            found = zip(*rows) if rows else [()] * len(_FEATURES)
            new = [pa.array(c, _KINDS[kind]) for c, kind in zip(found, _FEATURES.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in carried], *new], [*carried, *_FEATURES])

    def schema(columns: list[str]) -> T.StructType:
        return T.StructType(
            [T.StructField(n, narrow.schema[n].dataType) for n in columns] + [T.StructField(n, _TYPES[kind]) for n, kind in _FEATURES.items()]
        )

    free = free_names(docs.select(*[f"`{c}`" for c in rest]), *_FEATURES)
    if others is None:
        return given.mapInArrow(run, schema(carried)).toDF(*rest, *free)
    judged = stage(given.mapInArrow(run, schema(carried)), "judged")
    doubt = ~F.col("base_failed") & ~F.col("kept")
    doubtful = stage_unless_empty(judged.where(doubt), "doubtful")
    parts = [judged.where(~doubt)]
    if doubtful is not None:
        more = (_reference(row) for row in others.toLocalIterator())
        while block := list(islice(more, LANGUAGES)):
            doubtful = stage(doubtful.mapInArrow(_second_look(block, body, matrix), schema(carried)), "doubtful")
        parts.append(doubtful)
    whole = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return whole.select(*names, *_FEATURES).toDF(*rest, *free)


def _odd(n_chars: int, by_class: float, n_words: int, by_word: float) -> bool:
    return (n_chars >= GUARD_CHARS and by_class > CHAR_LIMIT) or (n_words >= GUARD_WORDS and by_word > WORD_LIMIT)


class _Nearest:
    """Up to ``LANGUAGES`` references, and a text's least distances from them."""

    def __init__(self, references: list[tuple]):
        self.classes = [r[0] for r in references if r[0] is not None]
        self.words = [r[1:3] for r in references if r[2] is not None]

    def distances(self, histogram: np.ndarray, words: list[str], own: tuple = (None, None, None)) -> tuple[float, float]:
        near = self.classes if own[0] is None else [*self.classes, own[0]]
        by_class = float(jensen_shannon(histogram, np.array(near)).min()) if near else math.inf
        counts = Counter(words)
        by_word = math.inf
        for places, reference in self.words if own[2] is None else [*self.words, own[1:3]]:
            mine = np.zeros(len(reference))
            for word in places.keys() & counts.keys():
                mine[places[word]] = counts[word]
            mine[-1] = len(words) - mine.sum()
            by_word = min(by_word, float(jensen_shannon(mine, reference)))
        return by_class, by_word


def _second_look(references: list[tuple], body: str, matrix: np.ndarray) -> Callable:
    """Distances and verdicts once these references are known too."""
    near = _Nearest(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for batch in batches:
            by_class, by_word, kept = [], [], []
            for text, c, w in zip(*[batch.column(n) for n in (body, "char_distance", "word_distance")]):
                text = text.as_py() or ""
                words, histogram = find(text), class_counts(text, matrix)
                nearest = [min(a, b.as_py()) for a, b in zip(near.distances(histogram, words), (c, w))]
                by_class.append(nearest[0])
                by_word.append(nearest[1])
                kept.append(not _odd(int(histogram.sum()), nearest[0], len(words), nearest[1]))
            new = {"char_distance": pa.array(by_class, pa.float64()), "word_distance": pa.array(by_word, pa.float64()), "kept": pa.array(kept)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return run


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, columns as they were."""
    judged = quality(docs, text, lang)
    return judged.where(F.col(f"`{judged.columns[-1]}`")).select(*[f"`{c}`" for c in docs.columns])
