"""Personal data by pattern, checksum and context, in DataFrame functions only.

Patterns propose spans, validators confirm them (octets of an address, Luhn, mod-97, digit counts) and words nearby move
the score. Spans of the base kinds stay whatever their score. All positions are code points. Texts without a pattern's
telling character skip its scan.

Built-in functions return matches but not places, so a place is summed from the pieces between matches (``split``)
and the matches themselves (``regexp_extract_all``), which cut the text alternately.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "secret")
#: A look-behind or \\G in front lets a failed run be left at once instead of being tried again from each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,200}+(?:\.[A-Za-z0-9-]+)*",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[a-z0-9_+/=.-]{16,}+[\"']?",
}
#: Cheap tests that every text with a match passes.
TELLING = {"email": "@", "ip": None, "card": None, "phone": "+", "iban": None, "ssn": "-", "secret": None}
SHAPES = {
    "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]",
    "secret": r"[=:][ \t]{0,4}[\"']?[A-Za-z0-9_+/=.-]{16}",
}
CONTEXT = {
    "email": "mail|contact|write to", "ip": "address|host|server|login", "card": "card|visa|master|credit|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer", "ssn": "ssn|social|security|insurance",
    "secret": "key|token|secret|auth|credential|login",
}
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "secret": 0.7}
WINDOW = 40
#: Matches whose places are added up in one array; more of a text's matches go by groups of as many.
GROUP = 128


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda a, c: F.struct(
            (a["i"] + 1).alias("i"),
            (a["s"] + F.when(c == "", 0).when(a["i"] % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.when(c.try_cast("int") > 4, 1).otherwise(0))).alias("s"),
        ),
    )
    return total["s"] % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters put last and letters read as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    left = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return left == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0"), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return luhn(_only_digits(m))
    if kind == "phone":
        return F.length(_only_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once; inside a condition Spark would compute it wherever it is named."""
    return F.transform(F.array(value), f)[0]


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start, end, score>> of the confirmed matches of one kind. Context are the ends of the pieces around a match."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split(text, PATTERNS[kind]).alias("pieces"))
    scored = once(cut, lambda c: _scored(kind, c["found"], c["pieces"]))
    may = F.contains(text, F.lit(TELLING[kind])) if TELLING[kind] else F.lit(True)
    may = may & text.rlike(SHAPES[kind]) if kind in SHAPES else may
    return F.when(may, scored).otherwise(F.array().cast("array<struct<start:int,`end`:int,score:double>>"))


def _scored(kind: str, found: Column, pieces: Column) -> Column:
    n = F.size(found)
    # Ends of what stands around a match: a piece, and the match and piece beyond it where that one is short.
    none, last = F.array(F.lit("")), F.lit(WINDOW)
    ends = lambda f, *parts: F.transform(F.arrays_zip(*[F.slice(p, at, n).alias(f"p{i}") for i, (p, at) in enumerate(parts)]), f)
    ahead = ends(lambda x: F.right(F.concat(F.right(x["p0"], last), x["p1"], F.right(x["p2"], last)), last), (F.concat(none, pieces), 1), (F.concat(none, found), 1), (pieces, 1))
    behind = ends(lambda x: F.left(F.concat(F.left(x["p0"], last), x["p1"], F.left(x["p2"], last)), last), (pieces, 2), (F.concat(found, none), 2), (F.concat(pieces, none), 3))
    met = F.arrays_zip(F.transform(F.slice(pieces, 1, n), F.length).alias("g"), found.alias("m"), ahead.alias("a"), behind.alias("z"))
    size = lambda x: x["g"] + F.length(x["m"])
    groups = once(met, lambda m: F.transform(F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0)).cast("int"), F.lit(GROUP)), lambda i: F.slice(m, i + 1, GROUP)))
    placed = once(groups, lambda g: _placed(g))
    valid = F.filter(placed, lambda s: confirmed(kind, s["m"]))
    hint = F.lit(f"\\b(?:{CONTEXT[kind]})")
    score = lambda s: F.lit(PRIOR[kind]) + F.when(F.rlike(F.lower(s["near"]), hint), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))


def _placed(groups: Column) -> Column:
    """Start, end, match and context of all matches of groups(array of arrays of g, m, a, z)."""
    size = lambda x: x["g"] + F.length(x["m"])
    # Where each group starts: only as many additions to an array as there are groups, and then as matches within one.
    starts = F.aggregate(
        F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda s, x: s + size(x))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
    )["out"]
    empty = F.array().cast("array<struct<start:int,`end`:int,m:string,near:string>>")
    span = lambda at, x: F.struct((at + x["g"]).alias("start"), (at + size(x)).alias("end"), x["m"].alias("m"), F.concat_ws(" ", x["a"], x["z"]).alias("near"))
    return F.flatten(F.zip_with(groups, starts, lambda g, at: F.aggregate(
        g, F.struct(at.alias("at"), empty.alias("out")),
        lambda s, x: F.struct((s["at"] + size(x)).alias("at"), F.concat(s["out"], F.array(span(s["at"], x))).alias("out")),
    )["out"]))


def named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))


def find_pii(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = BASE + EXTRA, least: float = 0.5, replace: dict[str, str] | None = None) -> DataFrame:
    """Columns of ``df`` and ``pii``: array<struct<kind, start, end, score>> by kind as listed, then start.

    Base kinds are listed whatever they score, the others from ``least``. Matches of one kind don't overlap; those of
    different kinds may. Null text counts as empty. A ``pii`` column of ``df`` is replaced.
    """
    value = text_or_empty(text)
    found = []
    for k in kinds:
        own = spans_of(k, value)
        own = own if k in BASE else F.filter(own, lambda s: s["score"] >= least)
        found.append(F.transform(own, named(k)))
    return df.withColumn("pii", F.concat(*found))


def masked(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace each span by its kind in brackets; of spans that overlap, the one that starts first, or else the longest."""
    value = text_or_empty(text)
    order = F.array_sort(F.transform(F.col(pii), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    out = F.aggregate(
        order,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["neg"]).alias("at"), F.concat(a["out"], F.substring(value, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
    )
    return df.withColumn(text, F.concat(out["out"], F.substring(value, out["at"] + 1, F.length(value))))
