"""Variants and DNA strings as column expressions. Positions are 1-based (VCF), windows 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ALLELE = 16
#: Edit types by number; base order of the 6-mer index; GC cuts.
EDIT_TYPES = ("SNV", "INS", "DEL", "MNV", "DELINS", "SV")
KMER_BASES, KMER = "ATCG", 6
GC_LOW, GC_HIGH = 1.0 / 3.0, 2.0 / 3.0


def supported_allele(allele: Column, longest: int = MAX_ALLELE) -> Column:
    return allele.rlike("^[ACGT]+$") & (F.length(allele) <= longest)


def chrom_rank(chrom: Column) -> Column:
    """Numeric chromosomes first, then X, Y, XY, MT, then others."""
    named = F.when(chrom == "X", 23).when(chrom == "Y", 24).when(chrom == "XY", 25).when(chrom == "MT", 26)
    return F.coalesce(F.when(chrom.rlike("^[0-9]+$"), chrom.try_cast("int")), named, F.lit(99))


def vcf_chrom(chrom: Column) -> Column:
    """Without chr; M is MT; only X, Y, XY and MT in upper case."""
    bare = F.regexp_replace(F.trim(chrom), "^(?i)chr", "")
    upper = F.upper(bare)
    return F.when(upper == "M", "MT").when(upper.isin("X", "Y", "XY", "MT"), upper).otherwise(bare)


def closed_chrom(chrom: Column) -> Column:
    """Canonical 1-22, X, Y, MT; null for anything else (01 is 1)."""
    bare = F.regexp_replace(F.upper(vcf_chrom(chrom)), "^0+(?=[0-9])", "")
    return F.when(bare.isin(*map(str, range(1, 23)), "X", "Y", "MT"), bare)


def importer_chrom(chrom: Column) -> Column:
    """As vcf_chrom, and 23 is X, 24 Y, 25 and 26 MT."""
    bare = F.upper(vcf_chrom(chrom))
    return F.when(bare == "23", "X").when(bare == "24", "Y").when(bare.isin("25", "26"), "MT").otherwise(bare)


def _common(x: Column, y: Column, most: Column) -> Column:
    """Length of the common prefix, at most `most`."""
    state = lambda n, go: F.struct(n.alias("n"), go.alias("go"))

    def step(s: Column, i: Column) -> Column:
        same = s["go"] & (i < most) & (F.substring(x, i + 1, F.lit(1)) == F.substring(y, i + 1, F.lit(1)))
        return state(s["n"] + F.when(same, 1).otherwise(0), same)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), state(F.lit(0), F.lit(True)), step, lambda s: s["n"])


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: a lambda's variable is bound, an expression used twice is computed twice."""
    return F.transform(F.array(value), use)[0]


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without shared context: suffix first, then prefix, keeping a base of each."""
    spare = lambda a, b: F.least(F.length(a), F.length(b)) - 1
    tail = let(F.struct(F.reverse(ref).alias("r"), F.reverse(alt).alias("a")), lambda x: _common(x["r"], x["a"], spare(x["r"], x["a"])))
    rest = let(tail, lambda n: F.struct(F.substring(ref, F.lit(1), F.length(ref) - n).alias("r"), F.substring(alt, F.lit(1), F.length(alt) - n).alias("a")))
    cut = lambda x, n: F.substring(x, n + 1, F.length(x))

    def headless(x: Column) -> Column:
        return let(_common(x["r"], x["a"], spare(x["r"], x["a"])), lambda n: F.struct((pos + n).cast("long").alias("pos"), cut(x["r"], n).alias("ref"), cut(x["a"], n).alias("alt")))

    return let(rest, headless)


def variant_key(assembly: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", assembly, chrom, pos.cast("string"), ref, alt)


def edit_type(ref: Column, alt: Column, longest: int = MAX_ALLELE) -> Column:
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r > longest) | (a > longest), "SV").when((r == 1) & (a == 1), "SNV").when(r == a, "MNV").when((r == 1) & (a > 1), "INS").when((r > 1) & (a == 1), "DEL").otherwise("DELINS")
    )


def dna(text: Column) -> Column:
    """Upper case; null unless all of ACGTN."""
    return F.when(F.upper(text).rlike("^[ACGTN]*$"), F.upper(text))


def window_sha256(sequence: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.upper(sequence), 256))


def gc_fraction(sequence: Column) -> Column:
    """GC share of the called bases; null without any."""
    called = F.length(F.regexp_replace(F.upper(sequence), "[^ACGT]", ""))
    return F.length(F.regexp_replace(F.upper(sequence), "[^GC]", "")).cast("double") / F.nullif(called.cast("double"), F.lit(0.0))


def gc_bin(fraction: Column) -> Column:
    return F.when(fraction <= GC_LOW, "low").when(fraction >= GC_HIGH, "high").when(fraction.isNotNull(), "mid")


def apply_edit(window: Column, at: Column, ref: Column, alt: Column, *, preserve_length: bool = False) -> Column:
    """The window with ref at the 0-based place `at` replaced; an error where the window reads otherwise. Length is kept by cutting, or padding with N,
    the side away from the edit."""
    reads = F.substring(window, at + 1, F.length(ref)) == ref
    left, right = F.substring(window, F.lit(1), at), F.substring(window, at + F.length(ref) + 1, F.length(window))
    out = F.when(reads, F.concat(left, alt, right)).otherwise(F.raise_error(F.lit("the window does not read REF")).cast("string"))
    if not preserve_length:
        return out
    n = F.length(window)
    on_right = at < F.floor(n / F.lit(2))
    longer = F.when(on_right, F.substring(out, F.lit(1), n)).otherwise(F.substring(out, F.length(out) - n + 1, n))
    return F.when(F.length(out) >= n, longer).when(on_right, F.rpad(out, n, F.lit("N"))).otherwise(F.lpad(out, n, F.lit("N")))


def apply_edits(window: Column, edits: Column) -> Column:
    """All edits (struct at, ref, alt) on one window, from right to left, so their order doesn't matter; overlapping ones are an error, none leave it as it is."""
    in_order = F.array_sort(edits)
    ends = F.zip_with(F.slice(in_order, 1, F.greatest(F.size(edits) - 1, F.lit(0))), F.slice(in_order, 2, F.size(edits)), lambda a, b: a["at"] + F.length(a["ref"]) > b["at"])
    clash = F.exists(ends, lambda x: x)
    out = F.aggregate(F.reverse(in_order), window, lambda s, e: F.concat(F.substring(s, F.lit(1), e["at"]), e["alt"], F.substring(s, e["at"] + F.length(e["ref"]) + 1, F.length(s))))
    return F.when(clash, F.raise_error(F.lit("edits overlap")).cast("string")).otherwise(out)


def centred_start(source_length: Column, centre: Column, window: int) -> Column:
    return F.greatest(F.lit(0), F.least(centre - window // 2, source_length - window))


def extract_window(source: Column, centre: Column, window: int) -> Column:
    """`window` bases around the 0-based centre, clamped to the source, padded with A on the right."""
    return F.rpad(F.substring(source, centred_start(F.length(source), centre, window) + 1, F.lit(window)), window, "A")


def pad_for_tokens(sequence: Column, token: int = KMER) -> Column:
    return F.rpad(sequence, (F.ceil(F.length(sequence) / F.lit(token)) * token).cast("int"), F.lit("A"))


def kmer_ids(sequence: Column, *, first_id: int = 0, oov: int = -1) -> Column:
    """Index of each 6-mer in base 4 in the order A, T, C, G; oov if it holds another base or is cut short. Linear in the length."""

    def one(kmer: Column) -> Column:
        digits = F.translate(kmer, KMER_BASES, "0123")
        return F.when(digits.rlike(f"^[0-3]{{{KMER}}}$"), F.conv(digits, 4, 10).cast("int") + first_id).otherwise(oov)

    kmers = F.regexp_extract_all(sequence, F.lit(f"(?s).{{1,{KMER}}}"), F.lit(0))
    return F.coalesce(F.transform(kmers, one), F.expr("cast(array() as array<int>)"))


def window_starts(length: Column, window: int, margin: int, stride: int) -> Column:
    """Starts of strided windows; none in a sequence under window + 2 * margin."""
    last = length - window - margin
    return F.when(length >= window + 2 * margin, F.sequence(F.lit(margin), last.cast("int"), F.lit(stride))).otherwise(F.expr("cast(array() as array<int>)"))


def edit_cost(ref: Column, alt: Column) -> Column:
    """Bases an edit touches: differing places for equal lengths, else the longer allele less the shared base."""
    same = F.length(ref) == F.length(alt)
    differ = F.aggregate(F.sequence(F.lit(1), F.length(ref)), F.lit(0), lambda s, i: s + F.when(F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1)), 1).otherwise(0))
    return F.when(same, differ).otherwise(F.abs(F.length(ref) - F.length(alt)))
