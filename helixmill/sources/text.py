"""Line-based sources: VCF, FASTA, JSONL, consumer genotype files; and the sinks that mirror them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixmill.functions.dna import chrom_rank, closed_chrom, importer_chrom, vcf_chrom
from helixmill.scratch import few, stored

#: Genotypes that mean no call.
NO_CALLS = ("", "--", "00", "NC", "II", "DD", "I", "D", "DI", "-", "NA")
TILE = 65_536


def info_map(raw: Column) -> Column:
    """INFO as a map: split on the first =, flags have a null value, the last of equal keys wins. Empty items are left out."""
    items = F.filter(F.split(raw, ";"), lambda x: (x != "") & (x != "."))
    at = lambda x: F.instr(x, "=")
    key = lambda x: F.when(at(x) > 0, F.substring(x, F.lit(1), at(x) - 1)).otherwise(x)
    value = lambda x: F.when(at(x) > 0, F.substring(x, at(x) + 1, F.length(x)))
    entries = F.transform(items, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda other: other["key"] == e["key"]))
    return F.map_from_entries(last)


def info_for_alt(info: Column, keys: list[str], index: Column) -> Column:
    """First key whose list has one element or one at index; a key that has neither falls through to the next."""

    def of(key: str) -> Column:
        parts = F.split(info[key], ",")
        return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).when(index < F.size(parts), F.get(parts, index))

    return F.coalesce(*map(of, keys))


def number(text: Column) -> Column:
    """Finite numbers; anything else is null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def whole(text: Column) -> Column:
    """The integer before the first comma or bar."""
    return F.regexp_extract(text, r"^\s*([^,|]*)", 1).try_cast("bigint")


def read_vcf(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """chrom, pos, id, ref, alt, alt_index, filter, info per ALT. Lines are cut at line ends, so a plain file is split over tasks (gzip can't be).

    ALTs that are empty or . are dropped before they are numbered; rows left without any are skipped. strict needs 8 fields and a position of 1 or more,
    lenient 5 fields and an ALT; what breaks the rule is an error."""
    return parse_vcf(spark.read.text(path), strict=strict)


def parse_vcf(lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """read_vcf's rows from a frame of lines (value)."""
    lines = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    need = 8 if strict else 5
    pos = F.get(f, F.lit(1)).try_cast("bigint")
    broken = (F.size(f) < need) | pos.isNull() | (pos < 1)
    alts = F.filter(F.split(F.upper(F.get(f, F.lit(4))), ","), lambda a: (a != "") & (a != "."))
    if not strict:
        broken |= F.size(alts) == 0
    checked = F.when(F.coalesce(broken, F.lit(True)), F.raise_error(F.concat(F.lit("bad VCF line: "), F.col("value"))).cast("bigint")).otherwise(pos)
    item = lambda i: F.get(f, F.lit(i))
    rows = lines.select(vcf_chrom(item(0)).alias("chrom"), checked.alias("pos"), item(2).alias("id"), F.upper(item(3)).alias("ref"), F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit(""))).otherwise(alts).alias("alts"), F.coalesce(item(6), F.lit(".")).alias("filter"), info_map(F.coalesce(item(7), F.lit(""))).alias("info"))
    return rows.select("*", F.posexplode("alts").alias("alt_index", "alt")).drop("alts")


def gnomad_rows(vcf: DataFrame, populations: tuple[str, ...] = ()) -> DataFrame:
    """read_vcf's rows with af and population frequencies."""
    af = lambda *keys: number(info_for_alt(F.col("info"), list(keys), F.col("alt_index")))
    return vcf.withColumns({"af": af("AF", "AF_global", "AF_GLOBAL")} | {f"af_{p}": af(f"AF_{p}", f"AF_{p.upper()}") for p in populations})


def clinvar_rows(vcf: DataFrame) -> DataFrame:
    from helixmill.functions.labels import clinical_significance

    raw = info_for_alt(F.col("info"), ["CLNSIG"], F.col("alt_index"))
    ident = F.coalesce(whole(F.col("info")["CLNVID"]), whole(F.col("info")["ALLELEID"]), whole(F.col("id")))
    gene = F.nullif(F.split_part(F.split_part(F.col("info")["GENEINFO"], F.lit("|"), F.lit(1)), F.lit(":"), F.lit(1)), F.lit(""))
    return vcf.withColumns({"cls": clinical_significance(raw), "review_status": F.coalesce(F.col("info")["CLNREVSTAT"], F.lit("")), "gene_symbol": gene, "clinvar_id": ident})


def read_fasta(spark: SparkSession, path: str, *, tile: int = TILE) -> DataFrame:
    """contig, start, sequence: contigs in tiles of `tile` bases, upper case. An empty or repeated contig is an error.

    A line's place is its file, the start of its split in it and its number there. Splits are summed first (bases before and after the last header), so a split's lines only
    need what came before it, one row a split; no task holds a file's lines or a contig as one string. Lines are read once, and stored with their places."""
    split, file = F.col("_metadata.file_block_start"), F.col("_metadata.file_path")
    lines = spark.read.text(path).select(F.trim("value").alias("line"), file.alias("file"), split.alias("split"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    order = Window.partitionBy("file", "split").orderBy("at")
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.col("line").startswith(">")
    bases = F.when(header, 0).otherwise(F.length("line"))
    head = F.when(header, F.struct("split", "at", F.split_part(F.substring("line", 2, 1_000_000), F.lit(" "), F.lit(1)).alias("name")))
    local = lines.withColumns({"head": F.max(head).over(inside), "upto": F.sum(bases).over(inside), "bare": header & F.lead("line").over(order).startswith(">")})
    local = stored(local.withColumn("from_head", F.max(F.when(header, F.col("upto"))).over(inside)), "fasta")
    # per split: its first and last line, its last header, and the bases after it (all, without one)
    edges = F.min_by(header, "at").alias("first_is_head"), F.max_by(header, "at").alias("last_is_head"), F.bool_or("bare").alias("bare")
    ends = stored(local.groupBy("file", "split").agg(F.max("head").alias("last"), (F.max("upto") - F.coalesce(F.max("from_head"), F.lit(0))).alias("tail"), *edges), "splits")
    along = Window.partitionBy("file").orderBy("split")
    bare = F.col("bare") | (F.col("last_is_head") & F.coalesce(F.lead("first_is_head").over(along), F.lit(True)))
    if ends.select(bare.alias("bare")).where("bare").limit(1).count():
        raise ValueError("a contig of the FASTA has no bases")
    named = local.where(header).select(F.col("head.name").alias("name")).groupBy("name").count().where("count > 1 or name = ''")
    if named.limit(1).count():
        raise ValueError("a contig stands twice in the FASTA, or has no name")
    before, until = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # bases of the open contig when a split begins: the tails since the last split with a header
    with_run = ends.withColumn("run", F.sum(F.when(F.col("last").isNotNull(), 1).otherwise(0)).over(until))
    tails = with_run.withColumn("sum", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opens = tails.select("file", "split", F.max("last").over(before).alias("open"), F.coalesce(F.lag("sum").over(along), F.lit(0)).alias("open_bases"))
    placed = local.join(opens, ["file", "split"])
    contig = F.coalesce("head", "open")
    start = F.when(F.col("head").isNotNull(), F.col("upto") - F.col("from_head")).otherwise(F.col("open_bases") + F.col("upto")) - F.length("line")
    body = placed.where(~header).select(contig.alias("contig"), "line", start.alias("from"))
    cut = F.explode(F.sequence(F.expr(f"`from` div {tile}"), F.expr(f"(`from` + length(line) - 1) div {tile}")))
    parts = body.select("contig.name", "from", "line", cut.alias("tile"))
    low = F.greatest(F.col("from"), F.col("tile") * tile)
    piece = F.substring("line", (low - F.col("from") + 1).cast("int"), (F.least(F.col("from") + F.length("line"), (F.col("tile") + 1) * tile) - low).cast("int"))
    whole_tiles = parts.groupBy("name", "tile").agg(F.array_sort(F.collect_list(F.struct(F.col("from"), piece.alias("s")))).alias("p"))
    return whole_tiles.select(F.col("name").alias("contig"), (F.col("tile") * tile).alias("start"), F.upper(F.array_join(F.col("p.s"), "")).alias("sequence"))


def contig_candidates(chrom: Column) -> Column:
    """Spellings to look a contig up by, best first."""
    bare = F.regexp_replace(chrom, "^(?i)chr", "")
    plain = F.array(chrom, bare, F.concat(F.lit("chr"), bare))
    return F.array_distinct(F.when(F.upper(bare).isin("M", "MT"), F.concat(plain, F.array(*map(F.lit, ("MT", "chrM", "M", "chrMT"))))).otherwise(plain))


def resolve_contigs(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """rows (chrom) with contig: the first of the chromosome's spellings that contigs (contig) has, else null. Spellings are looked up once per chromosome."""
    names = rows.select("chrom").distinct()
    tried = names.select("chrom", F.posexplode(contig_candidates(F.col("chrom"))).alias("at", "contig"))
    found = tried.join(contigs.select("contig").distinct(), "contig").groupBy("chrom").agg(F.min_by("contig", "at").alias("contig"))
    return rows.join(few(found, "spellings"), "chrom", "left")  # one row a chromosome


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, *, closed: bool = False) -> DataFrame:
    """JSON lines of a fixed schema; a broken line is an error. closed: each line must hold exactly the schema's keys, once each."""
    if not closed:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    keys = F.array_sort(F.json_object_keys("value"))
    names = sorted(f.name for f in spark.createDataFrame([], schema).schema)
    ok = (keys == F.array(*map(F.lit, names))) & (F.trim("value") != "")
    checked = F.when(ok, parsed).otherwise(F.raise_error(F.concat(F.lit("not the closed schema: "), F.col("value"))).cast(parsed_type(schema)))
    return lines.select(checked.alias("r")).select("r.*")


#: Keys of a placed window's line.
PLACED = "record_id string, source string, variant_source string, chrom string, start_bp long, end_bp long, sequence string, variant_count long"


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """Placed windows from JSON lines of exactly the eight keys. A blank name, a chromosome in another than its plain spelling, a negative start, no variants, other letters than upper-case bases, or an interval of another
    length than its sequence is an error."""
    rows = read_jsonl(spark, path, PLACED, closed=True)
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("record_id", "source", "variant_source", "chrom", "sequence")]
    spelled = ~F.coalesce(closed_chrom(F.col("chrom")) == F.col("chrom"), F.lit(False))
    rules = {"a name is blank": reduce(lambda a, b: a | b, blank), "the chromosome is not in its plain spelling": spelled, "start_bp is below 0": F.col("start_bp") < 0, "variant_count is below 1": F.col("variant_count") < 1}
    rules |= {"the sequence is not upper-case bases": ~F.col("sequence").rlike("^[ACGTN]+$"), "the interval is not as long as the sequence": F.col("end_bp") - F.col("start_bp") != F.length("sequence")}
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for why, bad in rules.items()))
    error = F.raise_error(F.concat(F.lit("bad placed window: "), reason)).cast("string")
    return rows.withColumn("record_id", F.when(reason.isNull(), F.col("record_id")).otherwise(error))


def parsed_type(schema: str) -> str:
    return "struct<" + ",".join(f"{p.split()[0]}:{' '.join(p.split()[1:])}" for p in schema.split(",")) + ">"


def read_genotypes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """rsid, chrom, pos, genotype of consumer files: 23andme, ancestry (five columns), myheritage (CSV) or sequencing (JSON)."""
    if kind == "sequencing":
        rows = spark.read.schema("rsid string, chromosome string, position long, genotype string").option("multiLine", True).json(path)
        return rows.select("rsid", importer_chrom(F.col("chromosome")).alias("chrom"), F.col("position").alias("pos"), F.upper("genotype").alias("genotype"))
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", '"', "")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#") & ~F.lower("value").startswith("rsid"))
    f = F.split("value", "," if kind == "myheritage" else r"\s+")
    item = lambda i: F.get(f, F.lit(i))
    genotype = F.concat(item(3), F.coalesce(item(4), F.lit(""))) if kind == "ancestry" else item(3)
    return lines.select(item(0).alias("rsid"), importer_chrom(item(1)).alias("chrom"), item(2).try_cast("bigint").alias("pos"), F.upper(genotype).alias("genotype"))


def genotypes_to_variants(calls: DataFrame, reference: DataFrame) -> DataFrame:
    """calls with ref, alt, gt and outcome (no_call, no_reference, hom_ref, alt); reference has chrom, pos, ref."""
    a, b = F.substring("genotype", 1, 1), F.when(F.length("genotype") > 1, F.substring("genotype", 2, 1)).otherwise(F.substring("genotype", 1, 1))
    alts = F.array_sort(F.array_distinct(F.filter(F.array(a, b), lambda x: x != F.col("ref"))))
    index = lambda x: F.when(x == F.col("ref"), "0").otherwise(F.array_position("alts", x).cast("string"))
    met = calls.join(reference, ["chrom", "pos"], "left").withColumn("alts", alts)
    outcome = F.when(F.col("genotype").isin(*NO_CALLS) | ~F.col("genotype").rlike("^[ACGT]{1,2}$"), "no_call").when(F.col("ref").isNull(), "no_reference").when(F.size("alts") == 0, "hom_ref").otherwise("alt")
    gt = F.when(F.length("genotype") == 1, index(a)).otherwise(F.array_join(F.array_sort(F.array(index(a), index(b))), "/"))
    return met.withColumn("outcome", outcome).select("rsid", "chrom", "pos", "ref", F.when(F.col("outcome") == "alt", F.array_join("alts", ",")).alias("alt"), F.when(F.col("outcome") == "alt", gt).alias("gt"), "outcome")


def write_vcf(rows: DataFrame, path: str) -> None:
    """rows of chrom, pos, id, ref, alt by chromosome rank, position, id and alleles, after a header. The files in order of their names are the sorted whole: each task writes a range of it, the first one the header."""
    header = rows.sparkSession.createDataFrame([(0, "##fileformat=VCFv4.2"), (1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")], "n int, value string").select(F.lit(-1).alias("c"), F.col("n").cast("bigint").alias("p"), F.lit("").alias("i"), "value")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."))
    body = rows.select(chrom_rank(F.col("chrom")).alias("c"), F.col("pos").cast("bigint").alias("p"), F.concat_ws("\t", F.coalesce("id", F.lit(".")), "ref", "alt").alias("i"), line.alias("value"))
    header.unionByName(body).orderBy("c", "p", "i").select("value").write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, at: all lines of the files below path, numbered from 1 in the order of file names and places. Lines are counted per split, and only these counts are summed along."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_row"))
    counts = stored(lines.groupBy("file", "split").agg(F.count("*").alias("n")), "lines")
    along = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = counts.select("file", "split", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "split").orderBy("_row")
    return lines.join(offsets, ["file", "split"]).select("value", (F.col("before") + F.row_number().over(inside)).alias("at"))


def write_jsonl(rows: DataFrame, path: str, **options: str) -> None:
    """Fields in alphabetical order, nulls kept. options are the writer's, such as compression; readers know it by the files' names."""
    rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").options(**options).json(path)
