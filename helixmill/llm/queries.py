"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.bpe import encode_and_decode
from helixmill.llm.exact_dedup import exact_dedup
from helixmill.llm.html_extract import extract
from helixmill.llm.langid import identify
from helixmill.llm.lexical_search import build_index, search
from helixmill.llm.licenses import scan
from helixmill.llm.mixing import mix
from helixmill.llm.near_dedup import near_duplicates
from helixmill.llm.pii import BASE, PATTERNS, find_pii, joined
from helixmill.llm.quality import quality
from helixmill.llm.substring_dedup import remove_repeated_windows
from helixmill.llm.suffix_dedup import remove_repeats
from helixmill.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform(F.concat(*PATTERNS), lambda x: x["score"]))
    return found.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE), F.sha2(joined(*BASE), 256).alias("base_sha256"), joined(*PATTERNS).alias("spans"), F.coalesce(best, F.lit(0.0)).alias("score")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def coded(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = encode_and_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def _vector_codes_sql() -> str:
    """Each round is two common tables: the parts' nearest entries, and the new codebooks."""
    assign = """
a{k} as (
  select vec, part, arg_min(entry, d * {entries} + entry) as entry, min(d) as d from (
    select parts.vec, parts.part, c.entry, sum((parts.x - c.x) * (parts.x - c.x)) as d from parts join c{k} c on parts.part = c.part and parts.place = c.place group by all
  ) group by all
)"""
    update = """
c{n} as (
  select c.part, c.entry, c.place, case when count(m.x) = 0 then any_value(c.x) else (sum(m.x) - ((sum(m.x) % count(m.x)) + count(m.x)) % count(m.x)) // count(m.x) end as x
  from c{k} c left join (select a{k}.part, a{k}.entry, parts.place, parts.x from a{k} join parts on a{k}.vec = parts.vec and a{k}.part = parts.part) m
  on c.part = m.part and c.entry = m.entry and c.place = m.place group by c.part, c.entry, c.place
)"""
    tables = [
        f"""
usable as (
  select vec_id, embedding::double[] as v, label, row_number() over (order by vec_id nulls last, embedding) as vec from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), kept as (
  select * from usable where len(v) = (select len(v) from usable where vec = 1)
), spread as (
  select vec, unnest(range(len(v))) as i, unnest(v) as x, len(v) // {PARTS} as width from kept
), parts as (
  select vec, i // width as part, i % width as place, floor({SCALE} * x)::bigint as x from spread
), c0 as (
  select part, rank - 1 as entry, place, x from parts join (select vec, row_number() over (order by vec) as rank from kept) using (vec) where rank <= {ENTRIES}
)"""
    ]
    for k in range(ROUNDS):
        tables += [assign.format(k=k, entries=ENTRIES), update.format(k=k, n=k + 1)]
    tables.append(assign.format(k=ROUNDS, entries=ENTRIES))
    tables.append(f"""
coded as (
  select vec, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by vec
)""")
    return f"""
with {",".join(tables)}
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(x::bigint::varchar, ',' order by part, entry, place)) from c{ROUNDS}) as codebooks_sha256
from coded join kept using (vec)"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_exact_dedup, op4_minhash, op5_bpe, op6_language_id, op7_mixing, op8_licenses, op9_html, op10_quality, op11_substring_dedup, op12_vector_codes, op13_lexical_search)}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents
), k as (
  select *, first_value(doc_id) over (partition by norm order by n_chars desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k""",
    "op11_substring_dedup": r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), starts as (
  select doc_id, unnest(range(1, len(words) - 48)) as p, words from w where len(words) >= 50
), windows as (
  select doc_id, p, doc_id > min(doc_id) over (partition by array_to_string(words[p:p + 49], ' ')) as gone from starts
), places as (
  select doc_id, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from w
), marked as (
  select places.doc_id, places.p, word, coalesce(max(case when gone then 1 else 0 end) over (partition by places.doc_id order by places.p rows between 49 preceding and current row), 0) as cut
  from places left join windows on places.doc_id = windows.doc_id and places.p = windows.p
), cut as (
  select doc_id, count(*) as n_words, sum(cut) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (cut = 0), '') as kept from marked group by doc_id
)
select documents.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join cut on documents.doc_id = cut.doc_id""",
    "op12_vector_codes": _vector_codes_sql(),
    "op13_lexical_search": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from benchmark
), s as (
  select count(*) as docs, sum(len(terms))::bigint as total from d where len(terms) > 0
), wanted as (
  select item_id, term, count(*) as times from (select item_id, unnest(terms) as term from i) group by all
), held as (
  select doc_id, n, term, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from d) group by all
), frequency as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from held, s where term in (select term from wanted) group by term, docs
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
  from wanted join frequency using (term) join held using (term), s group by all
)
select item_id, rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0
) where rank <= 10""",
}
