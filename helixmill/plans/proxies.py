"""Genomic-shaped views of the driver's tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("P", "LP", "B", "LB", "VUS", "OTHER")

#: Variants from lineitem, windows from orders, scores with labels from documents and labels, vectors with their successors from embeddings.
SQL = {
    "v": """select cast(l_partkey % 22 + 1 as varchar) as chrom, cast(l_orderkey * 8 + l_linenumber as bigint) as pos, substr('ACGT', cast(l_suppkey % 4 as int) + 1, 1) as ref,
 substr('ACGT', cast((l_suppkey + 1 + l_linenumber % 3) % 4 as int) + 1, 1) as alt, l_discount as af, case when l_returnflag = 'R' then 'LowQual' else 'PASS' end as flt,
 case cast(l_quantity as int) % 6 when 0 then 'P' when 1 then 'LP' when 2 then 'B' when 3 then 'LB' when 4 then 'VUS' else 'OTHER' end as cls,
 cast(l_orderkey * 8 + l_linenumber as bigint) as source_row_id, l_returnflag as source from lineitem""",
    "vk": """
select *, 'GRCh38:' || chrom || ':' || cast(pos as varchar) || ':' || ref || ':' || alt as variant_key, case when chrom = '20' then 'validation' when chrom = '21' then 'evaluation' else 'train' end as role
from v""",
    "w": """
select o_orderkey as id, cast(o_custkey % 22 + 1 as varchar) as chrom, cast(o_orderkey * 8 - (o_orderkey * 8) % 64 as bigint) as start_bp, cast(o_orderkey * 8 - (o_orderkey * 8) % 64 + 4096 as bigint) as end_bp
from orders""",
    "sl": """
select d.doc_id as id, l.quality as label, l.toxic as other, cast(d.n_chars % 50 as double) as score, cast(d.n_chars as double) as value, d.lang as grp
from documents d join labels l on d.doc_id = l.doc_id""",
    "e": """
select a.vec_id as id, cast(a.label as int) as split, cast(a.embedding as double[]) as x, cast(b.embedding as double[]) as y
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "rv": """select v.source_row_id, cast(v.pos % 230 as varchar) as chrom, 1 + (v.pos * 131) % (coalesce(length(d.seq), 0) + 20) as pos, v.ref, v.alt, v.cls, length(d.seq) as n, d.seq
 from v left join dseq d on d.id = v.pos % 230 and length(d.seq) > 0""",
    "dseq": """select doc_id as id, source, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAN') as seq from documents""",
}
_NEEDS = {"vk": ("v",), "rv": ("v", "dseq")}


def with_views(*names: str) -> str:
    """A WITH clause that defines these views (and those they need)."""
    order = list(dict.fromkeys(x for n in names for x in (*_NEEDS.get(n, ()), n)))
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lambda n: F.substring(F.lit("ACGT"), n.cast("int") + 1, F.lit(1))
    names = F.array(*map(F.lit, CLASSES))
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 22 + 1).cast("string").alias("chrom"),
        row.alias("pos"),
        base(F.col("l_suppkey") % 4).alias("ref"),
        base((F.col("l_suppkey") + 1 + F.col("l_linenumber") % 3) % 4).alias("alt"),
        F.col("l_discount").alias("af"),
        F.when(F.col("l_returnflag") == "R", "LowQual").otherwise("PASS").alias("filter"),
        F.element_at(names, F.col("l_quantity").cast("int") % 6 + 1).alias("cls"),
        row.alias("source_row_id"),
        F.col("l_returnflag").alias("source"),
    )


def keyed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixmill.functions.dna import variant_key
    from helixmill.operators.variants import role

    return variants(spark, sf_dir).select("*", variant_key(F.lit("GRCh38"), F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant_key"), role(F.col("chrom")).alias("role"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") * 8 - (F.col("o_orderkey") * 8) % 64).cast("bigint")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 22 + 1).cast("string").alias("chrom"), start.alias("start_bp"), (start + 4096).alias("end_bp"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.select("doc_id", "n_chars", "lang").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("toxic").alias("other"), (F.col("n_chars") % 50).cast("double").alias("score"), F.col("n_chars").cast("double").alias("value"), F.col("lang").alias("grp")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y"))
    return e.select("vec_id", F.col("label").cast("int").alias("split"), F.col("embedding").cast("array<double>").alias("x")).join(y, "vec_id").withColumnRenamed("vec_id", "id")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN").alias("seq"))


#: Spellings of two sources.
ALIASES = {f"src {n}": ("genome", "mrna")[n % 2] for n in range(100)}
CLEAN_SQL = """
select case when id % 3 = 0 then left(sha256(seq), 16) else 'r' || id end as record_id, seq, case when cast(replace(source, 'src', '') as int) % 2 = 0 then 'genome' else 'mrna' end as source
from dseq where length(seq) > 0 and id % 11 <> 0 and id % 7 <> 3 and id % 13 <> 5"""


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a hub has them, judged: some lack a sequence, some have an unknown source, some hold other letters, some are blank by name, and the cases and spellings vary."""
    from helixmill.operators.corpus import judged

    n = F.col("id")
    sequence = F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 5, F.concat("seq", F.lit("-J"))).when(n % 2 == 0, F.lower("seq")).otherwise(F.col("seq"))
    source = F.when(n % 14 == 3, F.lit(None)).when(n % 7 == 3, "elsewhere").otherwise(F.regexp_replace("source", "src", " SRC-/ "))
    name = F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("r"), n.cast("string")))
    return judged(sequences(spark, sf_dir).select("id", name.alias("record_id"), sequence.alias("sequence"), source.alias("source")), ALIASES)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as a contig named by its id, in tiles, stored as a genome is."""
    from helixmill.operators.tiles import of_sequences
    from helixmill.scratch import stored

    return stored(of_sequences(sequences(spark, sf_dir).select(F.col("id").cast("string").alias("contig"), F.col("seq").alias("sequence"))), "reference")


def on_reference(spark: SparkSession, sf_dir: str, contigs: DataFrame) -> DataFrame:
    """Variants over 230 contigs, some of which don't exist; some positions lie past a contig's end, and most REFs are not what the contig has."""
    from helixmill.operators.tiles import lengths

    v = variants(spark, sf_dir).withColumn("contig", (F.col("pos") % 230).cast("string"))
    met = v.join(lengths(contigs), "contig", "left").withColumn("pos", F.col("pos") * 131 % (F.coalesce("length", F.lit(0)) + 20) + 1)
    return met.select("source_row_id", F.col("contig").alias("chrom"), "pos", "ref", "alt", "cls")


def draw_sql(ident: str, n: int | str, seed: str = "7") -> str:
    """SQL of functions.digests.draw for an SQL text expression."""
    return f"cast(('0x' || substr(sha256('{seed}:' || {ident}), 1, 15))::ubigint % ({n}) as bigint)"
