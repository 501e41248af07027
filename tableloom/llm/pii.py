"""Personal data: regular expressions propose spans, checksums confirm, context words weigh.

Each kind has a pattern, a check of the matched text and a starting score. Matches are leftmost
and do not overlap within a kind; one that fails its check is dropped. Words near a span (40
characters before, 20 after) add to its score. Kinds of the base list (email, ip, card, phone) are
reported whenever their check holds; the others (iban by mod-97, national numbers and
bank accounts by context) when their score reaches 0.6.

Positions come from SQL functions alone: the gaps between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so running sums of their lengths are the positions.
An iban's pattern finds its first four characters; what follows is looked at for the longest
confirmed number that ends at a border, of the length its country fixes where that is known.
The patterns are written so that the search is linear in the text: runs are taken whole
(possessive) and no search starts inside a run that has failed.

Defined results: NULL text is the empty text; texts without a span give empty lists.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.text import free_names, let, running_sums, text_of

THRESHOLD = 0.6
BEFORE, AFTER = 40, 20


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _number_of_digits(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(least, most)


def _always(match: Column) -> Column:
    return F.lit(True)


def small_parts(match: Column) -> Column:
    """Every part of a dotted number is at most 255."""
    plain = lambda p: F.ltrim(p, F.lit("0"))
    # Of equal length, numbers compare like their texts.
    return F.forall(
        F.split(match, r"\."),
        lambda p: (F.length(plain(p)) < 3) | ((F.length(plain(p)) == 3) & (plain(p) <= "255")),
    )


def luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    from_right = F.split(F.reverse(_digits(match)), "")
    parts = F.transform(
        F.filter(from_right, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    total = F.aggregate(parts, F.lit(0), lambda a, b: a + b)
    return F.when(_number_of_digits(12, 19)(match), total % 10 == 0).otherwise(F.lit(False))


def mod97(match: Column) -> Column:
    """An account number whose rearranged digits leave 1 when divided by 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(turned, lambda c: c != ""),
        F.lit(0),
        lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(F.lit(False))


# Lengths of account numbers that countries fix.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG CR DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
}
IBAN_REST = 60  # characters after the first four, spaces included


def account_number(window: Column) -> Column:
    """The longest confirmed account number at the start of the window, or NULL."""
    run = lambda w: F.regexp_extract(w, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 0)
    fixed = F.create_map(*[F.lit(v) for n, lands in _LENGTHS.items() for land in lands.split() for v in (land, n)])

    def fits(w: Column, r: Column, k: Column) -> Column:
        part = F.left(r, k)
        length = F.length(F.regexp_replace(part, " ", ""))
        at_border = ~F.substr(r, k, F.lit(1)).eqNullSafe(" ") & ~F.regexp_like(F.substr(w, k + 1, F.lit(1)), F.lit("[A-Za-z0-9]"))
        return at_border & (length == F.coalesce(F.try_element_at(fixed, F.left(r, F.lit(2))), length)) & mod97(part)

    def best(w: Column, r: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(15), F.greatest(F.length(r), F.lit(15))), lambda k: (k <= F.length(r)) & fits(w, r, k))
        return F.left(r, F.array_max(ends))

    return let(window, lambda w: let(run(w), lambda r: best(w, r)))


@dataclass(frozen=True)
class Kind:
    """``probe``: what a text must hold for the pattern to be tried at all."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    words: str
    base: bool = False
    probe: str = "[0-9]"
    whole: Callable[[Column], Column] | None = None  # of a match and the characters after it, the whole span


# The patterns of the base kinds, in the order in which they are listed.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _always,
        0.9,
        "mail|contact|write to|courriel|correo",
        True,
        "@",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        small_parts,
        0.7,
        "ip|address|host|server",
        True,
        r"[0-9]\.[0-9]",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.8, "card|visa|credit|payment|carte|tarjeta", True),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _number_of_digits(9, 15),
        0.7,
        "phone|call|tel|mobile|fax",
        True,
        r"\+[0-9]",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
        mod97,
        0.8,
        "iban|account|bank|konto|compte|cuenta",
        False,
        "[A-Z]{2}[0-9]{2}",
        account_number,
    ),
    Kind(
        "national_id",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        _always,
        0.4,
        "ssn|social security|tax|passport|national",
        False,
        "[0-9]-[0-9]",
    ),
    Kind(
        "account",
        r"(?<![0-9A-Za-z.-])[0-9]{8,12}(?![0-9A-Za-z-])",
        _always,
        0.3,
        "account number|konto|compte|cuenta|routing",
        False,
        "[0-9]{8}",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
_SPANS = "array<struct<start:bigint,end:bigint,rank:int,kind:string,score:double>>"


def _spans(text: Column, found: Column, kind: Kind, rank: int) -> Column:
    """Checked spans of one kind, given its matches."""

    def placed(gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))
        return F.transform(
            running_sums(steps),
            lambda before, i: F.struct(
                F.get(found, i).alias("m"), (before + F.length(F.get(gaps, i))).alias("start"), i.alias("i")
            ),
        )

    # What lies around a match, from its neighbours' ends: as every match has two characters or more,
    # so many neighbours reach far enough, and a text's windows cost no search for their places.
    def ahead_of(gaps: Column) -> Column:
        return F.transform(gaps, lambda g, i: F.right(F.concat_ws("", F.get(found, i - 1), g), F.lit(BEFORE)))

    reach = AFTER + (IBAN_REST if kind.whole else 0)

    def past(gaps: Column) -> Column:
        return F.transform(gaps, lambda g, i: F.left(F.concat_ws("", g, F.get(found, i)), F.lit(reach)))

    def before(parts: Column, i: Column) -> Column:
        first = F.greatest(i - BEFORE // 2, F.lit(0))
        return F.right(F.array_join(F.slice(parts, first + 1, i - first + 1), ""), F.lit(BEFORE))

    def after(parts: Column, i: Column) -> Column:
        return F.left(F.array_join(F.slice(parts, i + 2, F.lit(reach // 2 + 1)), ""), F.lit(reach))

    def weighed(x: Column, left: Column, right: Column) -> Column:
        follows = after(right, x["i"])
        if kind.whole:
            follows = F.left(F.substr(follows, F.length(x["m"]) - F.length(F.get(found, x["i"])) + 1), F.lit(AFTER))
        near = F.lower(F.concat(before(left, x["i"]), F.lit(" "), follows))
        return F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(x["m"])).alias("end"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            F.round(F.lit(kind.score) + F.when(F.regexp_like(near, F.lit(rf"\b(?:{kind.words})")), 0.3).otherwise(0.0), 2).alias("score"),
        )

    def checked(gaps: Column, left: Column, right: Column) -> Column:
        matches = placed(gaps)
        if kind.whole:
            matches = F.transform(
                matches,
                lambda x: F.struct(kind.whole(F.concat(x["m"], after(right, x["i"]))).alias("m"), x["start"].alias("start"), x["i"].alias("i")),
            )
        return F.transform(F.filter(matches, lambda x: kind.check(x["m"])), lambda x: weighed(x, left, right))

    scored = let(
        F.split(text, kind.pattern, -1),
        lambda gaps: let(ahead_of(gaps), lambda left: let(past(gaps), lambda right: checked(gaps, left, right))),
    )
    if not kind.base:
        scored = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    return F.when(F.size(found) > 0, scored).otherwise(F.array()).cast(_SPANS)


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with an array of (start, rank, end, kind, score), sorted by start and kind.

    Its column is called ``name``, with an underscore in front if that is taken.
    """
    name, whole, *found = free_names(docs, name, "__text", *[f"__found_{k.name}" for k in KINDS])
    body = F.col(whole)
    matched = docs.withColumn(whole, text_of(F.col(f"`{text}`"))).withColumns(
        {
            column: F.when(
                F.regexp_like(body, F.lit(kind.probe)), F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
            ).otherwise(F.array().cast("array<string>"))
            for column, kind in zip(found, KINDS)
        }
    )
    spans = F.concat(*[_spans(body, F.col(c), kind, i) for i, (c, kind) in enumerate(zip(found, KINDS))])
    resolved = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["score"]))
    )
    return matched.withColumn(name, resolved).drop(whole, *found)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; columns as they were.

    Where spans overlap, one mark named by the first stands for their union.
    """
    spans, plain = free_names(docs, "__spans", "__plain")
    found = with_spans(docs, text, spans)
    # Each span hides what follows the furthest end before it; a covered one adds no mark.
    reach = F.transform(
        F.col(spans),
        lambda s, i: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            F.coalesce(F.array_max(F.transform(F.slice(F.col(spans), F.lit(1), i), lambda e: e["end"])), F.lit(0)).alias("past"),
        ),
    )
    body = F.col(f"`{text}`")
    pieces = F.transform(
        F.col(plain),
        lambda s: F.when(
            s["start"] >= s["past"],
            F.concat(
                F.substr(body, s["past"].cast("int") + 1, (s["start"] - s["past"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")
            ),
        ).otherwise(F.lit("")),
    )
    last = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))
    hidden = F.concat(F.array_join(pieces, ""), F.substr(body, last.cast("int") + 1))
    return (
        found.withColumn(plain, reach)
        .withColumn(text, F.when(F.size(spans) > 0, hidden).otherwise(body))
        .drop(spans, plain)
        .select(*[f"`{c}`" for c in docs.columns])
    )
