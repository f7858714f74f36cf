"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, mixing, pii, tokens
from .common import table
from .decontaminate import contaminated
from .line_dedup import drop_repeated_lines
from .simhash import near_duplicates
from .substring_dedup import drop_repeated_substrings
from .topk import top_k


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_substrings(table(spark, sf_dir, "documents"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "kept")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_rows(table(spark, sf_dir, "documents"), tokens.default_tokenizer(), end_id=2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_pii, op3_substring_dedup, op4_language, op5_mixing, op6_topk, op7_tokens, op8_simhash, op9_html, op10_line_dedup)}

ORACLE_SQL = {
    "op1_decontamination": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as a from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as a from benchmark),
bs as (select distinct item_id, least(len(a), 5) as k, array_to_string(a[i : i + least(len(a), 5) - 1], ' ') as s
       from (select item_id, a, unnest(range(1, len(a) - least(len(a), 5) + 2)) as i from b where len(a) > 0)),
n as (select item_id, count(*) as n_item from bs group by item_id),
ds as (select distinct doc_id, k, array_to_string(a[i : i + k - 1], ' ') as s
       from (select doc_id, a, k, unnest(range(1, len(a) - k + 2)) as i from d, (select distinct k from bs) where len(a) >= k)),
m as (select doc_id, item_id, count(*) as n_shared from ds join bs using (k, s) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from m join n using (item_id) where n_shared >= 0.8 * n_item - 1e-9
""",
    "op6_topk": r"""
with v as (select vec_id, [floor(256 * x::double) for x in embedding] as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""",
    "op10_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where f.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id
""",
}
