"""The registered queries of the numbered operators, with their SQL.

Each query reads its whole table, applies its operator, and derives the
result's digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import ann, decontamination, language_id, license_scan, line_dedup, mixing, ngram_join, periodic_runs, quality, token_alignment, token_ids, toxicity, warc
from lumenspan.llm.common import documents, fold_of, held_out, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "keep")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    seen = docs.where(fold_of(F.col("doc_id")) != 2)
    net = toxicity.fit(seen, table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id")) != 2))
    return toxicity.score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "flagged")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(language_id.sample_runs(docs.where(fold_of(F.col("doc_id")) != 2)))
    out = language_id.identify(docs, model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.roundtrip(documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", decontamination.items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.plant(documents(spark, sf_dir))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.align(documents(spark, sf_dir))
    return out.select("doc_id", *token_alignment.NUMBERS, F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, fold = documents(spark, sf_dir), table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(3)
    context = quality.context_sums(docs)
    net = quality.train(docs.where(fold != 1), labels.where(fold != 1), context)
    return quality.score(docs.select("doc_id", "text"), context, net).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
g5 as (select doc_id, hash(x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o) as g, lead(x, 4) over o is not null as full_ from u window o as (partition by doc_id order by i)),
t0 as (select distinct doc_id, g from g5 where full_ union all select doc_id, hash(array_to_string(ws, ' ')) from w where len(ws) between 1 and 4),
n as (select w.doc_id, coalesce(c, 0)::bigint as n from w left join (select doc_id, count(*) as c from t0 group by doc_id) using (doc_id)),
t as (select doc_id, n, g from t0 join n using (doc_id)),
f as (select g, count(*) as c from t group by g),
r as (select t.doc_id, t.n, t.g, c, row_number() over (partition by t.doc_id order by c, t.g) as k from t join f using (g)),
p as (select doc_id, n, g from r where c > 1 and k <= n - (80 * n + 99) // 100 + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
common as (select cand.a, cand.b, count(*) as x from cand join t ta on ta.doc_id = cand.a join t tb on tb.doc_id = cand.b and tb.g = ta.g group by all),
e as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * x >= 80 * (na.n + nb.n - x)),
both_ as (select a, b from e union select b, a from e),
walk(a, b) as (select doc_id, doc_id from n union select walk.a, both_.b from walk join both_ on walk.b = both_.a)
select n.doc_id, n.n as n_shingles, min(walk.b)::bigint as component_id from n join walk on walk.a = n.doc_id group by all
"""

OP8_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (
  select distinct item_id, size, win from (
    select item_id, least(len(ws), 13) as size, array_to_string(ws[k:k + least(len(ws), 13) - 1], ' ') as win
    from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as k from i where len(ws) > 0))),
sizes as (select distinct size from iw),
dw as (
  select doc_id, k, size, array_to_string(ws[k:k + size - 1], ' ') as win
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as k from d, sizes where len(ws) >= size)),
m as (select doc_id, k, dw.size, item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
h as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(k, k + size)) as p from m) group by doc_id),
t as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_ngram_join, op4_toxicity, op5_language_id, op6_nearest, op7_token_ids, op8_decontaminate, op9_license_scan, op10_warc, op11_periodic_runs, op12_token_alignment, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.oracle_sql(), "op2_line_dedup": line_dedup.ORACLE_SQL, "op3_ngram_join": OP3_SQL, "op8_decontaminate": OP8_SQL}
