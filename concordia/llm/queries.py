"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.brown import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op2_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.rangejoin import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), 0.95)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.secrets import scan_secrets

    return scan_secrets(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.langid import detect_languages

    return detect_languages(_read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.html import extract_main_text

    return extract_main_text(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=80)


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.winnow import fingerprint_documents

    return fingerprint_documents(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.llm.rollups import corpus_token_counts

    return corpus_token_counts(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_brown, op2_range_join, op3_secrets, op4_mixing, op5_langid, op6_html, op7_packing, op8_minhash, op9_winnow, op10_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_range_join": OP2_SQL, "op8_minhash": OP8_SQL, "op10_token_counts": OP10_SQL}


OP2_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
w as (select vec_id, list_transform(e, lambda x: x / n) as e from u where n > 0),
l as (select a.vec_id as a, b.vec_id as b from w a join w b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) >= 0.95),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
k as (select a, count(*) as n_links from l group by a)
select v.vec_id, coalesce(k.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept from v join c on c.a = v.vec_id left join k on k.a = v.vec_id
"""

OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as x from documents),
s as (select distinct doc_id, unnest(case when len(x) = 0 then [] when len(x) < 4 then [array_to_string(x, ' ')]
  else list_transform(range(1, len(x) - 2), lambda i: array_to_string(x[i:i + 3], ' ')) end) as h from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
g as (select a, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, g.component_id, d.doc_id = g.component_id as kept from documents d join g on g.a = d.doc_id left join n on n.doc_id = d.doc_id
"""


OP10_SQL = r"""
with c as (
  select source, lang, doc_id, 'words-1' as tokenizer_version,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from documents
  union all
  select source, lang, doc_id, 'wordpunct-1',
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[^A-Za-z0-9_\x{80}-\x{10FFFF}\x20\x09-\x0D]')) from documents
)
select source, lang, tokenizer_version, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_tokens
from c where doc_id is null or doc_id % 7 <> 3
group by all having count(*) <> 0 or sum(n) <> 0
"""
