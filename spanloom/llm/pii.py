"""Personal data in texts, by DataFrame functions only.

A regular expression proposes spans of each kind, a checksum or range check confirms them, and words nearby adjust a
score. Spans of the base kinds (email, ip, card, phone) that pass their check always stay; those of the added kinds
(iban, national id) stay if their score reaches the threshold.

Patterns are possessive and anchored at the first place where a run can begin, so a long run costs linear time and no
stack; they match what the plain patterns in the comments match, leftmost first and without overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "nid")
KINDS = BASE + ADDED

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a local part begins where its run begins, or where the last match ended.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: such a chain is maximal, so it begins after no digit and after no digit with one separator.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "nid": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "nid": "-"}
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "nid": 0.3}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|master|credit|payment",
    "phone": "phone|call|tel|mobile|contact|fax",
    "iban": "iban|account|bank|transfer",
    "nid": "ssn|social|security|identity|passport|national",
}
BEFORE, AFTER, BONUS, THRESHOLD = 40, 20, 0.3, 0.5
#: The column in which masked() keeps spans; it is not returned.
SPANS = "__spans_to_mask"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Every second digit from the right is doubled, less 9 beyond 9; the sum divides by 10."""
    d = F.split(F.reverse(_digits(x)), "")
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _mod97(x: Column) -> Column:
    """The account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(F.when(c.between("0", "9"), a * 10).otherwise(a * 100) + value(c), F.lit(97))) == 1


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(OCTET))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(x)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (start, ord, end, kind, score), offsets in code points, end exclusive."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        hits = F.when(F.contains(text, F.lit(NEEDS[kind])), hits)
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    parts = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        keep = x["hit"].isNotNull() & F.coalesce(_confirmed(kind, x["hit"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    placed = F.when(F.size(hits) > 0, F.aggregate(parts, begin, step, lambda acc: acc["out"])).otherwise(none)

    def scored(s):
        near = F.lower(F.substr(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE)) + s["end"] - s["start"] + AFTER))
        score = F.when(near.rlike(CONTEXT[kind]), F.least(F.lit(1.0), F.lit(PRIOR[kind] + BONUS))).otherwise(F.lit(PRIOR[kind]))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.filter(F.transform(placed, scored), lambda s: F.lit(kind in BASE) | (s["score"] >= THRESHOLD))


def find(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with one more column `into`: all confirmed spans, by start and then kind in the order of KINDS.

    Each span has start and end (code points, end exclusive), ord (place in KINDS), kind and score from 0 to 1. A null or
    empty text has none. A column named `into` that docs already has is replaced; other columns and rows pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c != into]
    each = docs.select(*[F.col(f"`{c}`") for c in kept], *[_spans(text, k).alias(f"__{k}") for k in KINDS])
    return each.select(*[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS])).alias(into))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.filter("pii_spans", lambda s: s["ord"] < len(BASE))), 256).alias("base_sha256"),
        _joined(F.col("pii_spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"),
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets; spans that overlap become one.

    Texts without spans, null ones included, stay as they are.
    """
    text = F.col(text_col)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(SPANS, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    found = find(docs, text_col, SPANS)
    return found.withColumn(text_col, F.when(F.size(SPANS) > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
