"""Canonical JSON and its digests, hash-based uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_sha256(**fields: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(**fields), 256))


def key_list_sha256(keys: Column) -> Column:
    """Digest of a group's sorted keys, written as a JSON list. The format is one text, so a group's keys meet in one task: groups should be chromosomes or the like."""
    quoted = F.transform(F.array_sort(F.collect_list(keys)), lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    return F.sha2(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), 256)


def uniform(seed: str, ident: Column) -> Column:
    """The first 8 bytes of sha256(seed:ident) as a share of 2 ** 64."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256), 1, 16)
    return F.conv(first, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def priority(seed: str, ident: Column) -> Column:
    """A seeded order over ids, as text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256)


def pick(draw: Column, weights: dict[str, float]) -> Column:
    """The name whose cumulative share a uniform draw falls into."""
    total, seen, out = sum(weights.values()), 0.0, None
    for name, weight in list(weights.items())[:-1]:
        seen += weight / total
        out = (F if out is None else out).when(draw < F.lit(seen), name)
    return out.otherwise(list(weights)[-1]) if out is not None else F.lit(next(iter(weights)))


def draw(seed: str, ident: Column, n: Column | int) -> Column:
    """A whole number from 0 to n - 1: the first 60 bits of sha256(seed:ident) modulo n."""
    first = F.conv(F.substring(priority(seed, ident), 1, 15), 16, 10).cast("long")
    return first % (F.lit(n) if isinstance(n, int) else n)


def framed(text: Column) -> Column:
    """The text's UTF-8 bytes after their number as 8 bytes, the highest first."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, F.lit("0"))), raw)
