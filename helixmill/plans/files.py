"""Registered queries on files: rows are written in a format's layout to the shared folder, read back by its reader, and compared with what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import tiles
from helixmill.operators import variants as ingest
from helixmill.plans.proxies import keyed_variants, read, reference, sequences, variants, windows
from helixmill.registry import query, r
from helixmill.scratch import folder
from helixmill.sources import shards, text


def _written(lines, name: str) -> str:
    """Path of the lines (value) as text."""
    path = folder(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


def _vcf_lines(v, info):
    """Eight-column lines of variants."""
    fields = (F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.col("source_row_id").cast("string"), F.lower("ref"), F.col("alt"), F.lit("."), F.col("filter"), info)
    return v.select(F.concat_ws("\t", *fields).alias("value"))


@query("S2_info_parse", "select source_row_id, af, cls, 'a=b' as x, true as has_flag, cast(4 as bigint) as n_keys from v", "v")
def s2(spark, sf_dir):
    """A flag, empty items, a repeated key (the last counts) and a value with = in it."""
    v = variants(spark, sf_dir)
    raw = F.concat(F.lit("DB;;AF=9;AF="), F.col("af").cast("string"), F.lit(";X=a=b;.;CLS="), "cls")
    m = v.select("source_row_id", text.info_map(raw).alias("m"))
    return m.select("source_row_id", F.col("m")["AF"].cast("double").alias("af"), F.col("m")["CLS"].alias("cls"), F.col("m")["X"].alias("x"), (F.map_contains_key("m", "DB") & F.col("m")["DB"].isNull()).alias("has_flag"), F.size("m").cast("long").alias("n_keys"))


@query("S4_lenient_scan", "select source_row_id, chrom, pos, ref, alt from v union all select source_row_id, chrom, pos, ref, 'TTT' from v where source = 'R'", "v")
def s4(spark, sf_dir):
    """Five columns are enough, and a missing ALT is an error; one row per ALT."""
    v = variants(spark, sf_dir)
    alts = F.when(F.col("source") == "R", F.concat("alt", F.lit(",ttt"))).otherwise(F.col("alt"))
    path = _written(v.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("source_row_id").cast("string"), "ref", alts).alias("value")), "lenient")
    return text.read_vcf(spark, path, strict=False).select(F.col("id").cast("long").alias("source_row_id"), "chrom", "pos", "ref", "alt")


@query("S5_fasta", """
select contig, start, sha256(piece) as digest, length(piece) as n
from (select 'd' || id as contig, i * 1000 as start, substr(seq, cast(i * 1000 + 1 as int), 1000) as piece
  from (select id, seq, unnest(range(cast(ceil(length(seq) / cast(1000 as double)) as bigint))) as i
    from dseq where length(seq) > 0))""", "dseq")
def s5(spark, sf_dir):
    """Contigs in lines of 60 bases, some in lower case, read in tiles of 1,000."""
    s = sequences(spark, sf_dir).where("length(seq) > 0")
    bases = F.when(F.col("id") % 2 == 0, F.lower("seq")).otherwise(F.col("seq"))
    record = F.concat(F.lit(">d"), F.col("id").cast("string"), F.lit(" a sequence\n"), F.array_join(F.regexp_extract_all(bases, F.lit("(?s).{1,60}"), F.lit(0)), "\n"))
    tiles = text.read_fasta(spark, _written(s.select(record.alias("value")), "fasta"), tile=1000)
    return tiles.select("contig", F.col("start").cast("long").alias("start"), F.sha2("sequence", 256).alias("digest"), F.length("sequence").cast("long").alias("n"))


@query("S6_contig_alias", """
select source_row_id, case when cast(chrom as int) % 3 = 0 then null when cast(chrom as int) % 2 = 0 then 'chr' || chrom else chrom end as contig
from v""", "v")
def s6(spark, sf_dir):
    """Chromosomes spelled either way against contigs spelled either way, a third of them absent."""
    v = variants(spark, sf_dir).withColumn("chrom", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("chr"), "chrom")).otherwise(F.col("chrom")))
    names = [f"chr{c}" if c % 2 == 0 else str(c) for c in range(1, 23) if c % 3]
    return text.resolve_contigs(v, spark.createDataFrame([(n,) for n in names], "contig string")).select("source_row_id", "contig")


@query("S7_jsonl", "select event_id, event_type, round(value, 6) as value from events")
def s7(spark, sf_dir):
    path = folder(spark, "events")
    text.write_jsonl(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return text.read_jsonl(spark, path, "event_id long, event_type string, value double").select("event_id", "event_type", r("value").alias("value"))


@query(
    "S8_closed_jsonl",
    """
select 'gnomad:' || chrom || ':' || (start_bp + 1) || '-' || (start_bp + n) as record_id, 'gnomad_common' as source, 'gnomad' as variant_source, chrom, start_bp, start_bp + n as end_bp, digest, variant_count from (
  select cast(id % 22 + 1 as varchar) as chrom, id * 64 as start_bp, length(seq) as n, sha256(seq) as digest, 1 + id % 9 as variant_count from dseq where length(seq) > 0
)""",
    "dseq",
)
def s8(spark, sf_dir):
    """Placed windows as lines and back: each line must hold exactly the eight keys, and its sequence must be as long as its interval."""
    path, n = folder(spark, "placed"), F.length("seq")
    s = sequences(spark, sf_dir).where(n > 0).withColumns({"chrom": (F.col("id") % 22 + 1).cast("string"), "start_bp": F.col("id") * 64})
    name = F.concat(F.lit("gnomad:"), "chrom", F.lit(":"), F.col("start_bp") + 1, F.lit("-"), F.col("start_bp") + n)
    lines = s.select(
        name.alias("record_id"), F.lit("gnomad_common").alias("source"), F.lit("gnomad").alias("variant_source"), "chrom", "start_bp", (F.col("start_bp") + n).alias("end_bp"), F.col("seq").alias("sequence"), (F.col("id") % 9 + 1).alias("variant_count")
    )
    text.write_jsonl(lines, path)
    return text.read_placed(spark, path).withColumn("digest", F.sha2("sequence", 256)).drop("sequence")


@query("S9_S12_gnomad_shard", """
select chrom, pos, ref, alt, cast(af as float) as af_global, cast(af / 2 as float) as af_afr, cast(null as float) as af_nfe, flt as filter, '2.0.0' as schema_version
from v where flt = 'PASS' and af >= 0.01""", "v")
def s9(spark, sf_dir):
    """The shard is written with all population columns, of which this source has one, and read with its schema and version checked."""
    good, _ = ingest.prepare(variants(spark, sf_dir), ingest.gnomad_reject())
    path = folder(spark, "gnomad")
    shards.write_shard(good.withColumns({"af_global": F.col("af"), "af_afr": F.col("af") / 2}), path, shards.GNOMAD)
    return shards.read_shard(spark, path, shards.GNOMAD).select("chrom", "pos", "ref", "alt", "af_global", "af_afr", "af_nfe", "filter", "schema_version")


@query("S10_clinvar_shard", """
select chrom, pos, ref, alt, cls as clinical_significance, '' as review_status, cast(null as varchar) as gene_symbol, source_row_id as clinvar_id
from v where ref <> alt""", "v")
def s10(spark, sf_dir):
    good, _ = ingest.prepare(variants(spark, sf_dir), ingest.clinvar_reject())
    path = folder(spark, "clinvar")
    shards.write_shard(good.select("chrom", "pos", "ref", "alt", F.col("cls").alias("clinical_significance"), F.lit("").alias("review_status"), F.col("source_row_id").alias("clinvar_id")), path, shards.CLINVAR)
    return shards.read_shard(spark, path, shards.CLINVAR).drop("schema_version")


@query("S11_stale_shard", "select true as fits, count(*) as n, count(*) filter (source = 'R') as stale from v union all select false, count(*), 0 from v", "v")
def s11(spark, sf_dir):
    """A shard with rows of an older version, and one that lacks a column."""
    v, path = variants(spark, sf_dir), folder(spark, "stale")
    old = F.col("source") == "R"
    rows, stale = (shards.shaped(v.where(x), shards.CLINVAR) for x in (~old, old))
    rows.unionByName(stale.withColumn("schema_version", F.lit("0.9.0"))).write.parquet(f"{path}/a")
    shards.shaped(v, shards.CLINVAR).drop("gene_symbol").write.parquet(f"{path}/b")
    return shards.stale_rows(spark.read.parquet(f"{path}/a"), shards.CLINVAR).unionByName(shards.stale_rows(spark.read.parquet(f"{path}/b"), shards.CLINVAR))


@query("S16_corpus_reader", "select doc_id as record_id, sha256(coalesce(text, '')) as digest, source from documents")
def s16(spark, sf_dir):
    records = shards.read_corpus(spark, f"{sf_dir}/documents.parquet", {"record_id": "doc_id", "sequence": "text", "source": "source"})
    return records.select("record_id", F.sha2(F.coalesce("sequence", F.lit("")), 256).alias("digest"), "source")


_KINDS = ("23andme", "ancestry", "myheritage", "sequencing")


def _consumer_calls(spark, sf_dir):
    """Each variant's genotype as one of the four files has it: heterozygous, homozygous for either allele, or no call."""
    v = variants(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("source_row_id") % 4 + 1).cast("int")))
    spot = F.col("pos") % 5
    one = F.when(spot == 4, "-").when(spot <= 1, F.col("alt")).otherwise(F.col("ref"))
    two = F.when(spot == 4, "-").when(spot == 1, F.col("alt")).otherwise(F.col("ref"))
    rows = v.select("kind", F.concat(F.lit("rs"), F.col("source_row_id").cast("string")).alias("rsid"), "chrom", "pos", one.alias("one"), two.alias("two"))
    out = None
    for kind in _KINDS:
        mine, p = rows.where(F.col("kind") == kind), F.col("pos").cast("string")
        if kind == "sequencing":
            path = folder(spark, kind)
            call = F.struct("rsid", F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.concat("one", "two").alias("genotype"))
            # files of one JSON array each, of a bounded stretch of positions
            arrays = mine.groupBy(F.expr("pos div 4096").alias("part")).agg(F.to_json(F.collect_list(call)).alias("value"))
            arrays.repartition("part").write.partitionBy("part").text(path)
        elif kind == "myheritage":
            quoted = F.concat_ws(",", *(F.concat(F.lit('"'), c, F.lit('"')) for c in (F.col("rsid"), F.col("chrom"), p, F.concat("one", "two"))))
            path = _written(mine.select(quoted.alias("value")), kind)
        else:
            genotype = (F.col("one"), F.col("two")) if kind == "ancestry" else (F.concat("one", "two"),)
            path = _written(mine.select(F.concat_ws("\t", "rsid", F.concat(F.lit("chr"), "chrom"), p, *genotype).alias("value")), kind)
        part = text.read_genotypes(spark, path, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_CALLS = """
select source_row_id, chrom, pos, ref, alt, ['23andme', 'ancestry', 'myheritage', 'sequencing'][cast(source_row_id % 4 + 1 as int)] as kind, case pos % 5 when 0 then alt || ref when 1 then alt || alt when 4 then '--' else ref || ref end as genotype
from v"""


@query("S17_consumer_genotypes", f"select kind, 'rs' || source_row_id as rsid, chrom, pos, genotype from ({_CALLS})", "v")
def s17(spark, sf_dir):
    return _consumer_calls(spark, sf_dir).select("kind", "rsid", "chrom", "pos", "genotype")


@query(
    "F25_genotype_rows",
    "select rsid, outcome, case when outcome = 'alt' then case when a <> ref and b <> ref and a <> b then least(a, b) || ',' || greatest(a, b) when a <> ref then a else b end end as alt, case when outcome = 'alt' then case when a = ref or b = ref then '0/1' when a = b then '1/1' else '1/2' end end as gt"
    " from (select *, case when genotype = '--' then 'no_call' when ref is null then 'no_reference' when a = ref and b = ref then 'hom_ref' else 'alt' end as outcome from (select 'rs' || c.source_row_id as rsid, c.genotype, substr(c.genotype, 1, 1) as a, substr(c.genotype, 2, 1) as b, k.ref"
    f" from ({_CALLS}) c left join (select chrom, pos, min(ref) as ref from v where pos % 7 <> 3 group by 1, 2) k on k.chrom = c.chrom and k.pos = c.pos))",
    "v",
)
def f25(spark, sf_dir):
    """No call, no reference, both bases the reference's, or a variant with its genotype; the reference lacks one position in seven."""
    known = variants(spark, sf_dir).where("pos % 7 <> 3").groupBy("chrom", "pos").agg(F.min("ref").alias("ref"))
    return text.genotypes_to_variants(_consumer_calls(spark, sf_dir), known).select("rsid", "outcome", "alt", "gt")


@query(
    "S18_vcf_sink",
    """
select row_number() over (order by cast(chrom as int), pos, cast(source_row_id as varchar), ref, alt) as at, chrom, pos, cast(source_row_id as varchar) as id, ref, alt from v""",
    "v",
)
def s18(spark, sf_dir):
    """All lines of the sink's files, numbered as they stand there, file after file."""
    path = folder(spark, "vcf")
    text.write_vcf(variants(spark, sf_dir).withColumn("id", F.col("source_row_id").cast("string")), path)
    f = F.split("value", "\t")
    return text.numbered_lines(spark, path).where("not startswith(value, '#')").select((F.col("at") - 2).alias("at"), f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"))


@query("S19_label_streams", """
select chrom, pos, ref, alt, case when cls in ('P', 'LP') then 'positive' else 'negative' end as label, count(*) as copies
from vk where role = 'evaluation' and cls in ('P', 'LP', 'B', 'LB')
group by all""", "vk")
def s19(spark, sf_dir):
    """A held role's labels and variants are written as two streams; here both are read and met again."""
    rows = keyed_variants(spark, sf_dir).where(F.col("cls").isin("P", "LP", "B", "LB")).withColumn("label", F.when(F.col("cls").isin("P", "LP"), "positive").otherwise("negative"))
    path, key = folder(spark, "evaluation"), ["chrom", "pos", "ref", "alt"]
    shards.write_role(rows, "evaluation", path)
    labels = text.read_jsonl(spark, f"{path}/labels", "chrom string, pos long, ref string, alt string, label string", closed=True)
    found = text.read_vcf(spark, f"{path}/variants").select(*key).distinct()
    return labels.join(found, key).groupBy(*key, "label").agg(F.count("*").alias("copies"))


@query(
    "S20_score_sinks",
    """
select chrom, pos, ref, alt, sigma_raw, bucket_id, 'sha256:' || sha256('{\"alt\":\"' || alt || '\",\"chrom\":\"' || chrom || '\",\"pos\":' || pos || ',\"ref\":\"' || ref || '\"}') as input_commitment
from (select distinct chrom, pos, ref, alt, cast(pos % 97 as double) / 4 as sigma_raw, source as bucket_id
  from v where ref <> alt)""",
    "v",
)
def s20(spark, sf_dir):
    """Scores and receipts, written as gzipped JSON lines and read back: the scores that have a receipt."""
    v = variants(spark, sf_dir).where("ref <> alt")
    raw = (F.col("pos") % 97).cast("double") / 4
    rows = v.select("chrom", "pos", "ref", "alt", F.col("source").alias("bucket_id")).distinct()
    scores = rows.select("chrom", "pos", "ref", "alt", raw.alias("sigma_raw"), (raw / 25).alias("sigma_calibrated"), "bucket_id")
    path = folder(spark, "scores")
    shards.write_scores(scores, "model-a", path, compression="gzip")
    again = text.read_jsonl(spark, f"{path}/scores", "chrom string, pos long, ref string, alt string, sigma_raw double, sigma_calibrated double, bucket_id string")
    receipts = text.read_jsonl(spark, f"{path}/receipts", "chrom string, pos long, ref string, alt string, model_id string, input_commitment string, output_commitment string")
    checked = shards.with_commitments(shards.receipted(again, receipts), "model-a")
    return checked.select("chrom", "pos", "ref", "alt", "sigma_raw", "bucket_id", "input_commitment")


@query(
    "S22_record_dispatch",
    """
select kind, count(*) as n, count(distinct key) as n_keys, count(label) as n_labels, min(pos) as first_pos, count(distinct chrom) as n_chroms
from (select chrom || ':' || pos || ':' || ref || ':' || alt as key, chrom, pos, ['jsonl', 'parquet', 'plain', 'vcf'][cast(source_row_id % 4 + 1 as int)] as kind, case when source_row_id % 4 < 2 then cls end as label
  from v) group by kind""",
    "v",
)
def s22(spark, sf_dir):
    """The same records in four formats, by one reader."""
    v, out = variants(spark, sf_dir).withColumn("label", F.col("cls")), None
    for k, kind in enumerate(("jsonl", "parquet", "plain", "vcf")):
        mine, path = v.where(F.col("source_row_id") % 4 == k), folder(spark, kind)
        if kind == "jsonl":
            text.write_jsonl(mine.select("chrom", "pos", "ref", "alt", "label"), path)
        elif kind == "parquet":
            mine.select("chrom", "pos", "ref", "alt", "label").write.parquet(path)
        elif kind == "vcf":
            path = _written(_vcf_lines(mine, F.lit(".")), kind)
        else:
            path = _written(mine.select(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("value")), kind)
        part = shards.read_records(spark, path, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.count("label").alias("n_labels"), F.min("pos").alias("first_pos"), F.count_distinct("chrom").alias("n_chroms"))


@query("S23_scored_csv", """
select 'a' || o_orderkey as accession, round(o_totalprice, 2) as score, 'k' || min(l_linenumber) as key
from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 5 <> 0
group by 1, 2""")
def s23(spark, sf_dir):
    """A CSV of scores, a fifth of them not numbers, and a mapping with several keys an accession."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    a, b = folder(spark, "csv"), folder(spark, "mapping")
    score = F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.round("o_totalprice", 2).cast("string"))
    orders.select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("accession"), score.alias("score")).write.option("header", True).csv(a)
    text.write_jsonl(lines.select(F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("accession"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key")), b)
    return shards.read_scored_csv(spark, a, b)


@query("S24_metric_lines", "select 'engine_events_total{event_type=\"' || event_type || '\"} ' || count(*) as value from events group by event_type")
def s24(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return shards.metric_lines(counts.select(F.lit("events_total").alias("name"), F.create_map(F.lit("event_type"), "event_type").alias("labels"), "value"), "engine_")


@query("S25_local_vcf", "select chrom, pos, ref, alt, af from v where flt = 'PASS' and af >= 0.01", "v")
def s25(spark, sf_dir):
    """Straight from a local VCF, without a shard."""
    path = _written(_vcf_lines(variants(spark, sf_dir), F.concat(F.lit("AF="), F.col("af").cast("string"))), "local")
    good, _ = ingest.prepare(text.gnomad_rows(text.read_vcf(spark, path)), ingest.gnomad_reject())
    return good.select("chrom", "pos", "ref", "alt", "af")


@query("F2_frequency_keys", """
select source_row_id, case when source = 'R' then null else af end as af, case when source = 'A' then af / 2 else af / 4 end as af_afr, cast(null as double) as af_nfe
from v""", "v")
def f2(spark, sf_dir):
    """The global frequency under either of its other names, a population under lower and upper case, one that is absent."""
    v = variants(spark, sf_dir)
    number = lambda c: c.cast("string")
    main = F.when(F.col("source") == "R", "AF=.").when(F.col("source") == "A", F.concat(F.lit("AF_global="), number(F.col("af")))).otherwise(F.concat(F.lit("AF_GLOBAL="), number(F.col("af"))))
    population = F.when(F.col("source") == "A", F.concat(F.lit("AF_afr="), number(F.col("af") / 2))).otherwise(F.concat(F.lit("AF_AFR="), number(F.col("af") / 4)))
    rows = text.gnomad_rows(text.parse_vcf(_vcf_lines(v, F.concat(main, F.lit(";"), population))), ("afr", "nfe"))
    return rows.select(F.col("id").cast("long").alias("source_row_id"), "af", "af_afr", "af_nfe")


@query(
    "F3_tolerant_numbers",
    """
select source_row_id, case source_row_id % 6 when 0 then cast(pos as double) when 1 then cast(pos as double) / 8 else null end as x, case source_row_id % 3 when 0 then pos when 1 then pos else null end as n
from v""",
    "v",
)
def f3(spark, sf_dir):
    """Numbers, NaN, infinities, junk and nothing; whole numbers before a comma or a bar."""
    p = F.col("pos").cast("string")
    shape = F.element_at(F.array(p, (F.col("pos") / F.lit(8.0)).cast("string"), F.lit("NaN"), F.lit("-Infinity"), F.lit("1e999"), F.lit("12x")), (F.col("source_row_id") % 6 + 1).cast("int"))
    whole = F.element_at(F.array(F.concat(p, F.lit(",7|8")), F.concat(F.lit(" "), p, F.lit("|9")), F.lit("x,1")), (F.col("source_row_id") % 3 + 1).cast("int"))
    return variants(spark, sf_dir).select("source_row_id", text.number(shape).alias("x"), text.whole(whole).alias("n"))


@query(
    "F5_clinvar_fields",
    """
select source_row_id, case when source = 'N' then '' else 'criteria_provided' end as review_status, case when source = 'R' then null else 'G' || chrom end as gene_symbol, case source when 'A' then source_row_id + 5 when 'R' then source_row_id + 9 else source_row_id end as clinvar_id
from v""",
    "v",
)
def f5(spark, sf_dir):
    """The id from CLNVID, else ALLELEID, else the row's own; the first gene's symbol; a status or none."""
    row = F.col("source_row_id")
    ident = F.when(F.col("source") == "A", F.concat(F.lit("ALLELEID=1;CLNVID="), (row + 5).cast("string"))).when(F.col("source") == "R", F.concat(F.lit("ALLELEID="), (row + 9).cast("string"), F.lit(",3"))).otherwise("DB")
    gene = F.when(F.col("source") == "R", "").otherwise(F.concat(F.lit(";GENEINFO=G"), "chrom", F.lit(":12|H:3")))
    status = F.when(F.col("source") == "N", "").otherwise(";CLNREVSTAT=criteria_provided")
    rows = text.clinvar_rows(text.parse_vcf(_vcf_lines(variants(spark, sf_dir), F.concat(ident, gene, status))))
    return rows.select(F.col("id").cast("long").alias("source_row_id"), "review_status", "gene_symbol", "clinvar_id")


@query(
    "J16_reference_windows",
    """
select source_row_id, start_bp, sha256(coalesce(substr(seq, cast(start_bp + 1 as int), 64), '')) as digest from (
  select v.source_row_id, k.start_bp % 200 as start_bp, d.seq from v
  left join (select chrom, start_bp + 1 as pos, min(start_bp) as start_bp from w group by 1, 2) k on k.chrom = v.chrom and k.pos = v.pos
  left join dseq d on d.id = cast(v.chrom as bigint)
)""",
    "v",
    "w",
    "dseq",
)
def j16(spark, sf_dir):
    """The last step of the lookup chain: the window's bases from the reference's tiles; none without a window."""
    w = windows(spark, sf_dir).groupBy("chrom", (F.col("start_bp") + 1).alias("pos")).agg((F.min("start_bp") % 200).alias("start_bp"))
    met = variants(spark, sf_dir).join(w, ["chrom", "pos"], "left").withColumnRenamed("chrom", "contig")
    found = tiles.fetch(met, tiles.with_halo(reference(spark, sf_dir), 64), F.col("start_bp"), 64, "bases")
    return found.select("source_row_id", "start_bp", F.sha2(F.coalesce("bases", F.lit("")), 256).alias("digest"))


@query("G24_json", """
select event_id, '{\"kind\":\"' || event_type || '\",\"nested\":{\"id\":' || event_id || ',\"none\":null}}' as report, event_type as kind
from events""")
def g24(spark, sf_dir):
    """Nested JSON out and in again, nulls kept."""
    e = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("none")).alias("nested")), {"ignoreNullFields": "false"}).alias("report"))
    return e.select("event_id", "report", F.get_json_object("report", "$.kind").alias("kind"))


@query("G25_timestamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def g25(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


