"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, mixing, packing, simhash, substring, token_output, topk, toxicity, warc
from ._common import table


def _crc(source: DataFrame, kept: list[str], out: list[str]) -> DataFrame:
    """``kept`` columns with the unsigned CRC-32 of ``ids`` (built in, as is the order of bytes)."""
    return source.select(*kept, F.crc32("ids").alias("ids_crc32")).select(*out)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.fold(F.col("doc_id"), 5) != 0))
    scores = toxicity.score(docs, model)
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_output.read(token_output.write(table(spark, sf_dir, "documents")))
    names = ["doc_id", "start", "n_tokens"]
    return _crc(back, names, [*names, "ids_crc32"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with warc.archive(table(spark, sf_dir, "pages")) as store:
        files = warc.write(store)
    records = warc.resolved(warc.read(files))
    return records.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


OP3_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
     d as (select page_id, octet_length(body) as n, sha1(body) as h from p),
     m as (select *, max(page_id) over (partition by h, n) as last from d)
select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
       case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> last then last end as refers_to
from m"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body, length(coalesce(text, '')) as points from documents),
     k as (select *, first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id,
                  count(*) over (partition by body) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from k"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    return _crc(pieces, names, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
     g as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)),
     f as (select *, min(doc_id) over (partition by h) as lo from g),
     c as (select distinct doc_id, unnest(range(i, i + 50)) as i from f where doc_id > lo),
     e as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
     k as (select e.doc_id, count(c.i) as n_removed, string_agg(e.word, ' ' order by e.i) filter (where c.i is null) as kept
           from e left join c on e.doc_id = c.doc_id and e.i = c.i group by e.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(toxicity.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~fold))
    return langid.predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_token_output, op3_warc, op4_exact_dedup, op5_packing, op6_mixing, op7_topk, op8_substring_dedup, op9_language_id, op10_simhash]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_topk": OP7_SQL, "op8_substring_dedup": OP8_SQL}
