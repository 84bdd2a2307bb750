"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embedding_dedup, hard_negatives, line_dedup, merkle, packing, quality, sharding, simhash, suffix_dedup, token_store, topk
from .common import table
from .tokens import default_path

SHARDS = 24


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(table(spark, sf_dir, "documents"), default_path()))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), default_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.hard_negatives(e.withColumn("label", moved), F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return merkle.manifest(docs, altered)


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_embedding_dedup, op3_simhash, op4_sharding, op5_chat_collapse, op6_decontamination, op7_line_dedup, op8_token_store, op9_packing, op10_quality, op11_hard_negatives, op12_topk, op13_merkle)
}

_SCORE = "-ln((('0x' || substr(md5(key || ':' || i), 1, 13))::bigint + 0.5) / 4503599627370496.0)"

_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::double))"
_SOUND = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_HALVED = "list_transform(range(0, (len(x) + 1) // 2), lambda j: sha256(x[2 * j + 1] || coalesce(x[2 * j + 2], '')))"


def _said(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"


ORACLES = {
    "op1_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
k as materialized (select doc_id, i, md5_number_lower(substr(h, 2 * i + 1, 800)) a, md5_number_upper(substr(h, 2 * i + 1, 800)) b from (select doc_id, h, unnest(range(0, n - 399)) i from d where n >= 400)),
r as (select doc_id, i from k qualify count(*) over (partition by a, b) > 1),
s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end first from r),
g as (select doc_id, i, sum(first) over (partition by doc_id order by i) g from s),
p as (select doc_id, min(i) a, max(i) + 400 b from g group by doc_id, g),
q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) z from p),
x as (select doc_id, count(*) n_spans, sum(b - a)::bigint n_removed, max(b) b, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) kept from q join d using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * b + 1), h))) as kept_sha256
from d left join x using (doc_id)""",
    "op2_embedding_dedup": """
with recursive e as (select vec_id, label, embedding::double[] v from embeddings),
l as materialized (select a.vec_id a, b.vec_id b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select vec_id id, vec_id c from e union select l.b, r.c from r join l on l.a = r.id),
m as (select id, min(c) c from r group by id), n as (select a, count(*) n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, m.c as component_id, vec_id = m.c as kept from e join m on m.id = vec_id left join n on n.a = vec_id""",
    "op4_sharding": f"""
with recursive bits(i, v, n) as (select i, i::bigint, 0 from range(0, 256) r(i) union all
    select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, n + 1 from bits where n < 8),
crc as (select list(v order by i) t from bits where n = 8),
k as (select doc_id, coalesce(text, '') body, coalesce(doc_id::varchar, '') key from documents),
s as (select doc_id, key, body, i, {_SCORE} score from k, range(0, 25) r(i)),
b as (select doc_id, key, body, arg_min(i, score) filter (i < 24) shard, arg_min(i, score) grown from s group by all)
select doc_id, strlen(body) + 8 as size,
       xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(0, strlen(body)), lambda j: ('0x' || substr(hex(encode(body)), 2 * j + 1, 2))::bigint),
           lambda c, x: xor(t[(xor(c, x) & 255) + 1], c // 256))) as text_crc32, 'key' as law, shard::int as shard, grown::int as grown_shard,
       row_number() over (partition by shard order by ('0x' || substr(md5(key), 1, 13))::bigint % 256, doc_id) - 1 as slot
from b, crc""",
    "op5_chat_collapse": """
with c as (select conv_id, list((coalesce(role, ''), coalesce(text, '')) order by turn) t, count(*) n,
                  string_agg('<|' || coalesce(nullif(role, ''), 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' order by turn) chat
           from (select *, case when conv_id is null then row_number() over () end alone from conversations) group by conv_id, alone),
e as (select t, min(conv_id) conv_id, count(*) n_copies, any_value(n) n, any_value(chat) chat from c group by t)
select conv_id, n::bigint as n_turns, n_copies::bigint as n_copies, chat from e
where not exists (select 1 from e b where b.n > e.n and b.t[1:e.n] = e.t)""",
    "op6_decontamination": r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark),
ds as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) s from dw where len(w) > 0),
si as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) s from iw where len(w) > 0),
n as (select *, count(*) over (partition by item_id) n_shingles from si)
select doc_id, item_id, n_shingles, count(*) as n_found, count(*) / n_shingles as containment
from n join ds using (s) group by doc_id, item_id, n_shingles having count(*) >= ceil(n_shingles * 0.8 - 1e-9)""",
    "op7_line_dedup": """
with d as (select doc_id, string_split(text, chr(10)) l from documents where text is not null),
w as (select doc_id, unnest(range(1, len(l) - 1)) pos, l from d where len(l) >= 3),
k as (select doc_id, pos, l[pos:pos + 2] k from w where trim(l[pos] || l[pos + 1] || l[pos + 2], ' ') <> ''),
r as (select doc_id, pos, row_number() over (partition by k order by doc_id, pos) rn from k),
c as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) i from r where rn > 1),
g as (select doc_id, list(i) gone from c group by doc_id)
select documents.doc_id, coalesce(len(d.l), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
       md5(case when gone is null then text else array_to_string(list_filter(d.l, lambda x, i: not list_contains(gone, i)), chr(10)) end) as kept_md5
from documents left join d using (doc_id) left join g using (doc_id)""",
    "op11_hard_negatives": f"""
with e as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE} v from embeddings where label is not null and {_SOUND}),
s as materialized (select a.vec_id anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5""",
    "op12_topk": f"""
with e as materialized (select vec_id, {_WHOLE} v from embeddings where {_SOUND}),
s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
    "op13_merkle": f"""
with recursive bits(i, v, n) as (select i, i::bigint, 0 from range(0, 256) r(i) union all
    select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, n + 1 from bits where n < 8),
crc as (select list(v order by i) t from bits where n = 8),
d as (select *, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(0, strlen(doc_id::varchar)), lambda j: ascii(substr(doc_id::varchar, j + 1, 1))::bigint),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c // 256))) % 7 = 0 as altered from documents, crc),
f as (select *, {_said("doc_id")} || {_said("source")} || {_said("lang")} a, {_said("text")} b from d),
h as (select doc_id, lang, sha256(a || {_said("n_chars")} || b) leaf, case when altered then sha256(a || {_said("(n_chars + 1)")} || b) end changed from f),
l as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i from h),
r as (select lang, 0 lvl, list(leaf order by i) x from l group by lang union all select lang, lvl + 1, {_HALVED} from r where len(x) > 1),
sub as (select lang, lvl height, x[1] subroot, row_number() over (order by lang nulls first) - 1 place from r where len(x) = 1),
top as (select 0 lvl, list(subroot order by place) x from sub union all select lvl + 1, {_HALVED} from top where len(x) > 1),
step as materialized (select lang, lvl, lvl as down, null::bigint as place, x from r where len(x) > 1 union all select lang, height + lvl, lvl, place, x from sub, top where len(x) > 1),
p as (select l.doc_id, l.lang, l.i, l.leaf, 0 lvl, coalesce(changed, leaf) h, '' proof from l union all
      select p.doc_id, p.lang, p.i, p.leaf, p.lvl + 1,
             case when (coalesce(place, i) >> down) % 2 = 1 then sha256(x[xor(coalesce(place, i) >> down, 1) + 1] || h) else sha256(h || coalesce(x[xor(coalesce(place, i) >> down, 1) + 1], '')) end,
             proof || coalesce(x[xor(coalesce(place, i) >> down, 1) + 1], '')
      from p join step on step.lvl = p.lvl and step.lang is not distinct from p.lang)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from p join sub on sub.lang is not distinct from p.lang, (select x[1] root, lvl tall from top where len(x) = 1) where p.lvl = height + tall""",
}
