"""PII spans: regular expressions propose, checksum validators confirm, context words adjust the score.

Everything is built-in SQL functions. regexp_extract_all gives a pattern's matches and split gives the gaps between them; running sums of
both lengths give each match's start and end in code points. Neither they nor the context of a span take longer the further into a text it is, so
a text's time grows with its length and the logarithm of its number of matches. The patterns are possessive and anchored at run starts (or at the end of the match
before, \\G), which finds the same leftmost matches in time linear in the text: a very long run of digits or letters is not tried again from
each of its characters.

Base kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits). Added by this method: iban (mod-97) and ssn, which
counts only when its score with context reaches `threshold`. A span's score is its kind's prior, plus `CONTEXT_BONUS` if one of the kind's words
stands within `CONTEXT_CHARS` before it; base spans stay whatever their score.

Scale: one pass, no shuffle, no Python; a text without '@', '+' or digits skips the patterns that need them.

Cases: null text counts as empty: no spans. Rows are independent, so ties and repeated rows need no rule. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm._base import text_or_empty

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text must hold this before the pattern is tried.
NEEDS = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|adresse|correo",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|mastercard|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.3, 0.5
#: Characters before a span are read from pieces of so many.
CHUNK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's remainder is 1: its first four characters go last, letters count as 10 to 35."""
    raw = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(raw, 5, 64), F.substring(raw, 1, 4))
    chars = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(chars, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)) == 1


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def running(lengths: Column) -> Column:
    """Running sums of an array of ints, by doubling: log2(n) passes, none of which grows an array."""
    shifts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(lengths).cast("double"))).cast("int") - 1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(shifts, lengths, lambda sums, shift: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - shift), F.lit(0))))


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of a kind, in order of start."""
    matches = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match"))

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))))
        spans = F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match")))
        return F.filter(spans, lambda s: s["match"].isNotNull() & _holds(kind, s["match"]))

    def scored(found: Column, chunks: Column) -> Column:
        def one(x: Column) -> Column:
            # the characters before a span are in its chunk and the one before it, wherever in the text that is
            at = F.floor(x["start"] / CHUNK).cast("int")
            near = F.concat(F.coalesce(F.get(chunks, at - 1), F.lit("")), F.substring(F.coalesce(F.get(chunks, at), F.lit("")), F.lit(1), x["start"] - at * CHUNK))
            score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(F.lower(F.right(near, F.lit(CONTEXT_CHARS))).rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)))
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

        return F.transform(found, one)

    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    spans = let(let(matches, placed), lambda found: F.when(F.size(found) == 0, none).otherwise(let(chunks, lambda c: scored(found, c))))
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    need = F.instr(text, NEEDS[kind]) > 0 if kind in ("email", "phone") else text.rlike(NEEDS[kind])
    return F.when(need, spans).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text, one array of spans per kind, named as in PATTERNS."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.select("doc_id", "text", *(spans_of(kind, F.col("text")).alias(kind) for kind in PATTERNS))


def joined(*arrays: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(F.concat(*arrays), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
