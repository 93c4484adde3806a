"""The three clinical-label normalisers, source aliases and annotation classes. Their rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clinical classes; spellings of the corpus sources.
POSITIVE, NEGATIVE = ("P", "LP"), ("B", "LB")
LABEL_RANK = {"P": 0, "LP": 1, "B": 2, "LB": 3}
GC_CLASSES = ("low", "mid", "high")


def clinical_significance(raw: Column) -> Column:
    """Ingest rule: tokens by | and / after decoding; VUS, then LP, P, LB, B, else OTHER."""
    text = F.replace(F.replace(F.lower(raw), F.lit("%2f"), F.lit("/")), F.lit("%20"), F.lit("_"))
    tokens = F.transform(F.split(text, "[|/]"), lambda t: F.trim(t))
    has = lambda *names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    return (
        F.when(raw.isNull(), "OTHER").when(has("uncertain_significance", "vus"), "VUS").when(has("likely_pathogenic"), "LP").when(has("pathogenic"), "P").when(has("likely_benign"), "LB").when(has("benign"), "B").otherwise("OTHER")
    )


def binary_label(labels: Column) -> Column:
    """Evaluation rule: true or false if all labels agree, else null (the row is skipped)."""
    known = F.transform(labels, lambda x: F.when(F.upper(x).isin("P", "LP", "PATHOGENIC", "LIKELY_PATHOGENIC"), 1).when(F.upper(x).isin("B", "LB", "BENIGN", "LIKELY_BENIGN"), 0))
    some = lambda v: F.exists(known, lambda x: x == v)
    odd = F.exists(known, lambda x: x.isNull())
    return F.when(odd | (F.size(labels) == 0), None).when(some(1) & ~some(0), True).when(some(0) & ~some(1), False)


def canonical_label(raw: Column) -> Column:
    """Integrity rule: booleans and 0 or 1 are positive or negative, texts by priority."""
    text = F.regexp_replace(F.lower(F.trim(raw.cast("string"))), r"[\s-]+", "_")
    return (
        F.when(text.isin("1", "true"), "positive").when(text.isin("0", "false"), "negative").when(text.contains("uncertain") | (text == "vus"), "VUS").when(text.contains("likely_pathogenic") | (text == "lp"), "LP")
        .when(text.contains("pathogenic") | (text == "p"), "P").when(text.contains("likely_benign") | (text == "lb"), "LB").when(text.contains("benign") | (text == "b"), "B").when(text.isNotNull(), "OTHER")
    )


def source_label(raw: Column, aliases: dict[str, str]) -> Column:
    """The key an alias stands for, after lower case, - and / to space and single spaces."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[-/]", " "), r"\s+", " "))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), plain)


def first_class(annotation: Column, groups: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """Name of the first group one of the annotation's terms is in."""
    terms = F.transform(F.split(F.lower(annotation), r"[,;|&+]+"), lambda t: F.regexp_replace(F.trim(t), r"[\s-]+", "_"))
    out = None
    for name, aliases in groups:
        out = (F if out is None else out).when(F.arrays_overlap(terms, F.array(*map(F.lit, aliases))), name)
    return out.otherwise(default)


def backoff_chain(region: Column, gc: Column, repeat: Column) -> Column:
    """From the leaf bucket to the catch-all."""
    return F.array(F.concat_ws("|", region, gc, repeat), F.concat_ws("|", region, gc), region, F.lit("*"))
