"""The registered queries, each next to the SQL that DuckDB answers it with."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags, modeljson, pytext
from ..operators import adjudicate, batches, citations, dedupe, fragments, ordered, overview, progress, review, scope, screening, workspace
from ..sinks import corpus_yaml, record_files
from ..sources import corpus, records, work_pages
from . import run as job
from . import screen
from .log import ResponseLog
from .state import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SQL that several queries share

_LINES = """lines as (select doc_id, source, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
f as materialized (select doc_id, source, lang, pos, trim(line) t, length(trim(line)) n, row_number() over (partition by doc_id order by pos) rn from lines where trim(line) <> '')"""
_FOLD = f"""{_LINES},
r as (select doc_id, pos, rn, 0 b, n c from f where rn = 1 union all
      select f.doc_id, f.pos, f.rn, case when r.c + f.n > 500 then r.b + 1 else r.b end, case when r.c + f.n > 500 then f.n else r.c + f.n end
      from r join f on f.doc_id = r.doc_id and f.rn = r.rn + 1)"""
_VERDICTS = f"""{_FOLD},
g as materialized (select f.*, r.b from f join r using (doc_id, pos)),
bt as (select doc_id, b, string_agg(t, chr(10) || chr(10) order by pos) txt, sum(n) chars from g group by all),
th(theme) as (values ('by the'), ('ment'), ('der')),
c as (select doc_id, b, theme from bt, th where contains(lower(txt), theme) or (contains(txt, theme) and chars > 200)),
v as (select g.doc_id, g.source, g.b, printf('%08d-%05d', g.doc_id, g.pos) piece_id, theme, g.t original_text, g.n, contains(lower(g.t), theme) l1,
             (contains(lower(g.t), theme) and g.n > 60) or g.n > 300 l2 from c join g using (doc_id, b))"""
_FINAL = f"""{_VERDICTS},
fin as (select doc_id, source, piece_id, theme, original_text, n, case when l1 and l2 then 'consensus' else 'arbitrated' end judgment,
               'llm1: ' || case when l1 then 'rule' else 'NA' end || ' | llm2: ' || case when l2 then 'rule' else 'NA' end || case when l1 and l2 then '' else ' | llm3: rule' end note
        from v where (l1 and l2) or (l1 <> l2 and n % 2 = 0))"""


# ---- scope

_SCOPE_TEXT = "concat(p_brand, ', KR', cast(1 + p_size % 6 as string), substr('abcXz', 1 + p_size % 5, 1), '，kr3J', lpad(cast(p_partkey % 10000 as string), 4, '0'))"
_LEVEL = "case when regexp_matches(token, '^KR[1-4][a-z]$') then 'family' when regexp_matches(token, '^KR[1-4][a-z]\\d{4}$') then 'repo' else 'invalid' end"


@query(rf"""
with x as (select p_partkey, list_filter(regexp_split_to_array(regexp_replace({_SCOPE_TEXT.replace("as string", "as varchar")}, '[，,]', ' ', 'g'), '\s+'), lambda a: a <> '') t from part),
n as (select p_partkey, list_transform(t, lambda a: case when lower(a) like 'kr%' and length(a) > 2 then 'KR' || lower(substr(a, 3)) else a end) t from x),
d as (select p_partkey, list_filter(t, lambda a, i: list_position(t, a) = i) t from n),
u as (select p_partkey, unnest(t) token, generate_subscripts(t, 1) - 1 pos from d)
select p_partkey, pos::int as pos, token, {_LEVEL} as level from u""")
def q_scope_classify(spark, sf):
    tokens = read(spark, sf, "part").select("p_partkey", F.posexplode(scope.split_tokens(F.expr(_SCOPE_TEXT))).alias("pos", "token"))
    return tokens.withColumn("level", scope.token_level(F.col("token")))


_TOKEN = """case s_suppkey % 4 when 0 then concat('KR', cast(1 + s_nationkey % 4 as string), substr('abcdefgh', 1 + s_nationkey % 5, 1))
 when 1 then concat('KR', cast(1 + s_nationkey % 4 as string), substr('abcdefgh', 1 + s_nationkey % 5, 1), lpad(cast(s_nationkey as string), 4, '0'))
 when 2 then concat('KR', cast(1 + s_nationkey % 4 as string), 'h', lpad(cast(s_suppkey as string), 4, '0')) else s_name end"""
_DIR = "concat('KR', cast(1 + n_nationkey % 4 as string), substr('abcdefgh', 1 + n_regionkey, 1), lpad(cast(n_nationkey as string), 4, '0'))"
_SCOPE_SQL = f"""
with tk as (select token, min(s_suppkey) ord from (select s_suppkey, {_TOKEN.replace("as string", "as varchar")} token from supplier) group by token),
t as (select *, {_LEVEL} level from tk), d as (select {_DIR.replace("as string", "as varchar")} repo_dir from nation),
fam as (select substr(repo_dir, 1, 4) token, string_agg(repo_dir, ',' order by repo_dir) dirs from d group by 1),
good as (select ord, token, level, dirs from t join fam using (token) where level = 'family' union all select ord, token, level, token from t join d on token = repo_dir where level = 'repo')"""


def _scope(spark, sf):
    tokens = read(spark, sf, "supplier").select(F.expr(_TOKEN).alias("token"), F.col("s_suppkey").alias("ord"))
    return dedupe.first_wins(tokens, ["token"], ["ord"]), read(spark, sf, "nation").select(F.expr(_DIR).alias("repo_dir"))


@query(f"{_SCOPE_SQL} select ord, token, level, dirs from good")
def q_scope_resolve(spark, sf):
    return scope.resolve_targets(*_scope(spark, sf)).select("ord", "token", "level", F.array_join("repo_dirs", ",").alias("dirs"))


@query(f"""{_SCOPE_SQL} select 0 as phase, ord, token, case level when 'family' then '{scope.NO_FAMILY}' when 'repo' then '{scope.NO_REPO}' else '{scope.BAD_TOKEN}' end as detail
from t where ord not in (select ord from good)
union all select 1, g.ord, g.token, '{scope.OVERLAP[0]}' || f.token || '{scope.OVERLAP[1]}' from good g join good f on f.level = 'family' and f.token = substr(g.token, 1, 4) where g.level = 'repo'""")
def q_scope_issues(spark, sf):
    return scope.scope_issues(*_scope(spark, sf))


@query("""
with a as (select n_regionkey, list('KR' || (1 + n_nationkey % 4) || 'a' order by n_nationkey) x, list('KR' || (1 + n_nationkey % 3) || 'b' order by n_nationkey) y from nation group by 1),
m as (select n_regionkey, list_concat(x, y) l, x from a),
u as (select n_regionkey, list_filter(l, lambda t, i: list_position(l, t) = i) l, x from m)
select n_regionkey, array_to_string(l, ',') as targets, array_to_string(list_filter(l, lambda t: not list_contains(x[2:], t) and t <> l[1]), ',') as pending from u""")
def q_target_union(spark, sf):
    names = lambda m, c: F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("kr"), (1 + k % m).cast("string"), F.lit(c)))
    t = read(spark, sf, "nation").groupBy("n_regionkey").agg(names(4, "A").alias("x"), names(3, "b").alias("y"))
    x = F.transform("x", scope.normalize_scope)
    t = t.select("n_regionkey", scope.merge_targets(F.col("x"), F.col("y")).alias("l"), F.slice(x, F.lit(2), F.size("x")).alias("done"))
    pending = scope.pending_targets(F.col("l"), F.col("done"), F.get("l", F.lit(0)))
    return t.select("n_regionkey", F.array_join("l", ",").alias("targets"), F.array_join(pending, ",").alias("pending"))


# ---- sources


@query("""select conv_id, turn, role, md5(coalesce(last_value(case when role = 'user' then text end ignore nulls)
 over (partition by conv_id order by turn rows between unbounded preceding and current row), '')) as user_md5 from conversations""")
def q_catalog_carry_forward(spark, sf):
    t = read(spark, sf, "conversations").withColumn("said", F.when(F.col("role") == "user", F.col("text")))
    return ordered.carry_forward(t, ["conv_id"], "turn", "said", "last").select("conv_id", "turn", "role", F.md5(F.coalesce("last", F.lit(""))).alias("user_md5"))


@query(r"""
with e as (select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) rn from documents)
select source as section, 'KR' || (1 + length(lang || source) % 4) || substr(lang, 1, 1) as code, lang as label, doc_id as first_doc from e where rn = 1
qualify row_number() over (partition by 'KR' || (1 + length(lang || source) % 4) || substr(lang, 1, 1) order by source, doc_id) = 1""")
def q_catalog_entries(spark, sf):
    # a catalogue file for each source: a section line, then an entry for each language
    e = dedupe.first_wins(read(spark, sf, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])
    code = F.concat(F.lit("kr"), (1 + F.length(F.concat("lang", "source")) % 4).cast("string"), F.substring("lang", 1, 1))
    e = e.withColumn("code", scope.normalize_scope(code))
    line = F.concat(F.lit("** [[file:"), F.col("code"), F.lit(".txt]["), F.col("lang"), F.lit("]]"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"])
    files = e.groupBy(F.col("source").alias("file_no")).agg(F.concat(F.lit("* KR1 "), F.first("source"), F.lit("\n\n"), F.array_join(rows, "\n")).alias("text"))
    found = corpus.catalog_entries(files)
    return found.join(e.select("source", "code", "lang", "doc_id"), (e.source == found.file_no) & (e.code == found.code) & (e.lang == found.label)).select(found.section, found.code, found.label, F.col("doc_id").alias("first_doc"))


_TITLED = "concat('#+TITLE: ', regexp_extract(html, '<title>([^<]*)</title>', 1), chr(10), html)"


@query(r"""
with t as (select page_id, regexp_extract(concat('#+TITLE: ', regexp_extract(html, '<title>([^<]*)</title>', 1), chr(10), html), '(?m)^#\+TITLE:\s*(.+)$', 1) a from pages)
select page_id, case when a = '' then 'page' || page_id when trim(split_part(trim(a), '/', 1)) = '' then '（未命名文献）' else trim(split_part(trim(a), '/', 1)) end as title from t""")
def q_title_extract(spark, sf):
    t = read(spark, sf, "pages").withColumn("raw", F.expr(_TITLED))
    return t.select("page_id", fragments.title(F.col("raw"), F.concat(F.lit("page"), "page_id")).alias("title"))


@query("""
select event_id, (regexp_extract(props, '-?\\d+'))::bigint as k, event_type as kind from events order by all""")
def q_record_parse(spark, sf):
    # every user's events as one record file, in one of the three shapes
    obj = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("kind")))
    e = read(spark, sf, "events").groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.collect_list(obj).alias("o"))
    joined = F.array_join("o", ",")
    shape = F.pmod(F.col("user_id"), F.lit(3))
    text = F.when(shape == 0, F.concat(F.lit('{"records":['), joined, F.lit("]}"))).when(shape == 1, F.concat(F.lit("["), joined, F.lit("]"))).otherwise(F.concat(F.array_join("o", "\n"), F.lit("\nnot a record\n")))
    return records.parse_records(e.select(text.alias("text")), "struct<event_id:bigint,k:bigint,kind:string>")


# ---- fragments

_CLEAN = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""select doc_id, printf('%08d_fallback_0001', doc_id) as piece_id, md5(array_to_string({_CLEAN}, chr(10))) as text_md5 from documents where len({_CLEAN}) > 0""")
def q_fragment_fallback(spark, sf):
    t = corpus.documents_corpus(read(spark, sf, "documents"))
    return fragments.fragment_rows(t).select(F.col("text_file").cast("bigint").alias("doc_id"), "piece_id", F.md5("original_text").alias("text_md5"))


@query(f"with {_LINES} select doc_id, pos::int as pos, doc_id || '_' || pos as piece_id, md5(t) as text_md5 from f")
def q_fragment_marked(spark, sf):
    # a page marker before every line, and a text before the first that is lost
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("<pb: "), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"), F.lit(" >"), x))
    t = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("lost\n"), F.array_join(marked, "\n¶")).alias("raw_text"), F.lit("none").alias("fallback_piece_id"))
    return fragments.fragment_rows(t).select("doc_id", "pos", "piece_id", F.md5("original_text").alias("text_md5"))


def _noisy() -> F.Column:
    """Each line, by its place: as a directive, a technical comment, a comment that stays, or between odd spaces and marks."""
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("#+P: "), x)).when(i % 5 == 1, F.concat(F.lit("　# KR1a0001_002 "), x)).when(i % 5 == 2, F.concat(F.lit(" # "), x)).otherwise(F.concat(F.lit("　 <pb:x>"), x, F.lit("¶ \r")))
    return F.array_join(F.transform(F.split("text", "\n"), line), "\n")


_KEPT = "select doc_id, pos, case when pos % 5 = 2 then trim('# ' || line) else trim(line) end c from lines where pos % 5 >= 2"


@query(rf"""with {_LINES}, k as ({_KEPT}), j as (select doc_id, coalesce(string_agg(c, chr(10) order by pos) filter (c <> ''), '') a, coalesce(string_agg(regexp_replace(c, '\s', '', 'g'), chr(10) order by pos) filter (c <> ''), '') b from k group by 1)
select documents.doc_id, md5(coalesce(a, '')) as clean_md5, md5(coalesce(b, '')) as compact_md5, length(replace(coalesce(b, ''), chr(10), ''))::int as n from documents left join j using (doc_id)""")
def q_fragment_clean(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", fragments.clean_forms(_noisy()).alias("c"))
    return t.select("doc_id", F.md5("c.clean").alias("clean_md5"), F.md5("c.compact").alias("compact_md5"), pytext.length_without_breaks(F.col("c.compact")).alias("n"))


@query("select doc_id, length(replace(text, chr(10), ''))::int as n from documents")
def q_fragment_length(spark, sf):
    return read(spark, sf, "documents").select("doc_id", pytext.length_without_breaks(F.col("text")).alias("n"))


@query(f"with {_LINES} select source, doc_id, pos::int as pos, n::int as n from f qualify row_number() over (partition by source order by doc_id, pos) <= 50")
def q_max_fragments(spark, sf):
    d = read(spark, sf, "documents")
    f = fragments.line_fragments(d).join(d.select("doc_id", "source"), "doc_id")
    return fragments.first_fragments(f, ["source"], ["doc_id", "pos"], 50).select("source", "doc_id", "pos", "n")


# ---- batches and sizes


@query(f"""with recursive {_LINES}, o as materialized (select *, row_number() over (partition by source order by doc_id, pos) i from f),
r as (select source, i, doc_id, pos, lang, n c, 1 b from o where i = 1 union all
      select o.source, o.i, o.doc_id, o.pos, o.lang, case when o.lang <> r.lang or r.c + o.n > 500 then o.n else r.c + o.n end, case when o.lang <> r.lang or r.c + o.n > 500 then r.b + 1 else r.b end
      from r join o on o.source = r.source and o.i = r.i + 1)
select source as target, doc_id, pos::int as pos, b::bigint as batch_ord from r""")
def q_batch_assign(spark, sf):
    d = read(spark, sf, "documents")
    f = d.select(F.col("source").alias("target"), F.col("source").alias("source_file"), F.col("lang").alias("repo_dir"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    f = f.withColumn("n", F.length(F.trim("t"))).where("n > 0").withColumn("ord", F.col("doc_id") * (1 << 24) + F.col("pos")).drop("t")
    return batches.assign_batches(f, keep=("doc_id", "pos")).select("target", "doc_id", "pos", "batch_ord")


@query(f"""with recursive {_FOLD} select doc_id, b::int as batch, 'batch_' || printf('%06d', b + 1) as batch_id, count(*)::int as n_pieces, sum(n)::int as char_count, md5(string_agg(t, chr(10) || chr(10) order by pos)) as text_md5
from f join r using (doc_id, pos) group by doc_id, b""")
def q_batch_rows(spark, sf):
    b = screen.document_batches(read(spark, sf, "documents"))
    return b.select("doc_id", "batch", F.format_string("batch_%06d", F.col("batch") + 1).alias("batch_id"), F.size("pieces").alias("n_pieces"), "char_count", F.md5("batch_text").alias("text_md5"))


_FILES = f"{_FOLD}, files as (select doc_id, source, lang, sum(n)::bigint chars, count(*)::bigint fragments, (max(b) + 1)::bigint batches from f join r using (doc_id, pos) group by all)"


def _files(spark, sf):
    f = fragments.line_fragments(read(spark, sf, "documents"))
    return overview.measure_files(f, ["doc_id"], "pos")


@query(f"with recursive {_FILES} select doc_id, chars, fragments, batches from files")
def q_batch_estimate(spark, sf):
    return _files(spark, sf)


def _overview(spark, sf, where: str = "true", files: DataFrame | None = None):
    """Sources as targets, (source, lang) as their directories, documents as files."""
    d = read(spark, sf, "documents").where(where).select("doc_id", F.col("source").alias("token"), F.concat_ws("/", "source", "lang").alias("repo_dir"))
    targets = d.groupBy("token").agg(F.sort_array(F.collect_set("repo_dir")).alias("repo_dirs")).withColumn("level", F.lit("family"))
    files = (_files(spark, sf) if files is None else files).join(d.select("doc_id", "repo_dir"), "doc_id").withColumnRenamed("doc_id", "text_file")
    return targets, overview.target_overview(targets, files)


_OVER = "select source token, 'family' as level, count(distinct source || '/' || lang)::bigint repo_dir_count, count(*)::bigint text_file_count, sum(chars)::bigint text_char_count, sum(fragments)::bigint fragment_count, sum(batches)::bigint batch_count from files"


@query(f"with recursive {_FILES} {_OVER} group by 1")
def q_overview_target(spark, sf):
    return _overview(spark, sf)[1]


@query(f"with recursive {_FILES} select count(distinct source || '/' || lang)::bigint repo_dir_count, count(*)::bigint text_file_count, sum(chars)::bigint text_char_count, sum(fragments)::bigint fragment_count, sum(batches)::bigint batch_count from files")
def q_overview_total(spark, sf):
    targets, o = _overview(spark, sf)
    return overview.overview_total(o, targets)


_MERGED = f"""{_FILES}, a as ({_OVER} where lang <> 'fr' group by 1), b as ({_OVER} where lang in ('en', 'fr') group by 1),
m as (select * from a where token not in (select token from b) union all select * from b)"""


@query(f"with recursive {_MERGED} select * from m")
def q_overview_merge(spark, sf):
    return overview.merge_overviews(_overview(spark, sf, "lang <> 'fr'")[1], _overview(spark, sf, "lang in ('en', 'fr')")[1])


@query(f"with recursive {_MERGED} select sum(repo_dir_count)::bigint repo_dir_count, sum(text_file_count)::bigint text_file_count, sum(text_char_count)::bigint text_char_count, sum(fragment_count)::bigint fragment_count, sum(batch_count)::bigint batch_count from m")
def q_overview_merge_total(spark, sf):
    return overview.merged_total(q_overview_merge(spark, sf))


_TIMING = f"""{_FILES}, o as ({_OVER} group by 1), t as (select token, batch_count, fragment_count, ceil(batch_count * 0.01)::bigint targeted_batch_count from o),
e as (select *, ((ceil(batch_count / 7) + ceil(targeted_batch_count / 7) + ceil(batch_count / 14) + ceil(targeted_batch_count / 14)) * 20)::bigint lower_bound_seconds from t)"""


@query(f"with recursive {_TIMING} select * from e")
def q_timing_estimate(spark, sf):
    return overview.timing(_overview(spark, sf)[1], 7, 14)


@query(f"with recursive {_TIMING} select sum(batch_count)::bigint batch_count, sum(fragment_count)::bigint fragment_count, sum(targeted_batch_count)::bigint targeted_batch_count, sum(lower_bound_seconds)::bigint lower_bound_seconds, ceil(sum(lower_bound_seconds) * 1.5)::bigint upper_bound_seconds from e")
def q_timing_total(spark, sf):
    return overview.timing_total(q_timing_estimate(spark, sf))


@query(f"""with recursive {_FILES}, o as (select count(*)::bigint files, sum(chars)::bigint chars, sum(fragments)::bigint fragment_count, sum(batches)::bigint batch_count from files), t as (select *, ceil(batch_count * 0.01)::bigint targeted_batch_count from o)
select '' as token, batch_count, fragment_count, targeted_batch_count, ((ceil(batch_count / 7) + ceil(targeted_batch_count / 7) + ceil(batch_count / 14) + ceil(targeted_batch_count / 14)) * 20)::bigint as lower_bound_seconds from t""")
def q_timing_without_targets(spark, sf):
    targets, o = _overview(spark, sf)
    return overview.timing(o.where("false"), 7, 14, total=overview.overview_total(o, targets))


# ---- what models answer

_THEMES = ("alpha", " ", "beta", "gamma")


@query(r"select conv_id, turn + 1 as idx, regexp_replace(text, '^\s+|\s+$', '', 'g') as theme from conversations where role = 'user' and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def q_theme_specs(spark, sf):
    # a conversation's turns as theme names; those of other roles are blank, so numbers have gaps
    t = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", F.col("text")).otherwise(" ").alias("t")))).alias("l"))
    specs = screening.theme_table(F.transform("l", lambda x: x["t"]))
    return t.select("conv_id", F.inline(specs)).select("conv_id", F.col("idx").cast("bigint").alias("idx"), "theme")


@query("""with k as (select event_id, regexp_extract(props, '-?\\d+')::bigint k from events)
select event_id, case k % 5 when 0 then 'alpha' when 1 then case k % 4 when 0 then 'alpha' when 2 then 'beta' when 3 then 'gamma' end when 2 then case k % 6 when 1 then 'alpha' when 3 then 'beta' when 4 then 'gamma' end when 3 then null else 'gamma' end as theme from k""")
def q_theme_resolve(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    ref = F.when(k % 5 == 0, " alpha ").when(k % 5 == 1, F.concat(F.lit("t"), (k % 4 + 1).cast("string"))).when(k % 5 == 2, F.concat(F.lit("0"), (k % 6).cast("string"))).when(k % 5 == 3, "delta").otherwise("gamma")
    return read(spark, sf, "events").select("event_id", flags.theme_ref(ref, *screening.theme_literals(_THEMES)).alias("theme"))


@query("""with k as (select event_id, event_type, regexp_extract(props, '-?\\d+')::bigint k from events),
f as (select event_id, case k % 6 when 0 then event_type when 1 then ' yes ' when 2 then 'f' when 3 then (k % 3)::varchar when 4 then (k % 2)::varchar || '.0' else '' end raw from k)
select event_id, case when upper(trim(raw)) in ('T', 'TRUE', 'Y', 'YES', '1', '1.0') then true when upper(trim(raw)) in ('F', 'FALSE', 'N', 'NO', '0', '0.0') then false end as flag from f""")
def q_flag_normalise(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = F.when(k % 6 == 0, F.col("event_type")).when(k % 6 == 1, " yes ").when(k % 6 == 2, "f").when(k % 6 == 3, (k % 3).cast("string")).when(k % 6 == 4, F.concat((k % 2).cast("string"), F.lit(".0"))).otherwise("")
    return read(spark, sf, "events").select("event_id", flags.to_bool(raw).alias("flag"))


@query("""with k as (select event_id, length(event_type) n, regexp_extract(props, '-?\\d+')::bigint k from events)
select event_id, case when n % 2 = 0 or k % 3 <> 2 then k end as k, case when n % 2 = 1 and k % 3 = 2 then 'format_error' else 'ok' end as status from k""")
def q_json_extract(spark, sf):
    k, n = F.get_json_object("props", "$.k").cast("bigint"), F.length("event_type")
    text = F.when(n % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k % 3 == 0, F.col("props")).when(k % 3 == 1, F.concat(F.lit("Here: "), F.col("props"), F.lit(" so."))).otherwise(F.concat(F.lit("{"), F.col("props")))
    found = modeljson.json_object(text)
    return read(spark, sf, "events").select("event_id", F.get_json_object(found, "$.k").cast("bigint").alias("k"), F.when(found.isNull(), "format_error").otherwise("ok").alias("status"))


@query("""with k as (select event_id, regexp_extract(props, '-?\\d+')::bigint k from events), t(theme, i) as (values ('alpha', 1), ('beta', 3), ('gamma', 4))
select event_id, theme, case when k % 4 = 3 then 'format_error' else 'ok' end as status,
       case when k % 4 = 3 then null when k % 4 = 0 then case i when 1 then k % 3 = 0 when 3 then k % 2 = 0 else false end
            when k % 4 = 1 then case i when 1 then k % 3 = 0 when 3 then false else true end else false end as is_relevant from k, t""")
def q_coarse_normalise(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    t = lambda c: F.when(c, "T").otherwise("F")
    flat = F.format_string('{"1":"%s","T3":"%s","alpha":"T","2":"T"}', t(k % 3 == 0), t(k % 2 == 0))
    listed = F.format_string('{"themes":[{"theme":"alpha","is_relevant":"%s"},{"theme_id":"1","is_relevant":true},{"index":4,"is_relevant":1},{"theme":"beta"}]}', t(k % 3 == 0))
    payload = F.when(k % 4 == 0, flat).when(k % 4 == 1, listed).when(k % 4 == 2, "{}").otherwise('{"9":"T"}')
    names, by_index = screening.theme_literals(_THEMES)
    e = read(spark, sf, "events").select("event_id", modeljson.coarse(payload, names, by_index).alias("c"))
    judged = F.coalesce("c.themes", F.transform(names, lambda n: F.struct(n.alias("theme"), F.lit(None).cast("boolean").alias("is_relevant"))))
    return e.select("event_id", F.col("c.status").alias("status"), F.inline(judged))


@query("""select conv_id, turn::varchar as piece_id, case when role = 'user' then role = 'user' else turn % 2 = 0 end as is_relevant,
case when role = 'user' then 'reason ' || turn when turn % 2 = 0 then '未提供相关理由' else 'NA' end as reason from conversations""")
def q_targeted_normalise(spark, sf):
    # user turns are mentioned without a flag, twice; even turns of others without a reason; the rest is denied; unknown ids are added
    item = F.when(F.col("role") == "user", F.format_string('{"piece_id":" %s ","reason":"reason %s"},{"piece_id":"%s","is_relevant":"T","reason":"again"}', F.col("turn").cast("string"), F.col("turn").cast("string"), F.col("turn").cast("string")))
    item = item.when(F.col("turn") % 2 == 0, F.format_string('{"piece_id":"%s","is_relevant":1,"reason":" "}', F.col("turn").cast("string")))
    item = item.otherwise(F.format_string('{"piece_id":"%s","is_relevant":"no","reason":"x"}', F.col("turn").cast("string")))
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))).alias("l"))
    payload = F.concat(F.lit('{"results":['), F.array_join(F.transform("l", lambda x: x["i"]), ","), F.lit(',{"piece_id":"none"}]}'))
    return c.select("conv_id", F.inline(modeljson.targeted(payload, F.transform("l", lambda x: x["turn"].cast("string")))["results"]))


@query("""with k as (select event_id, regexp_extract(props, '-?\\d+')::bigint k from events)
select event_id, k % 4 in (0, 3) as is_relevant, case when k % 2 = 0 then 'r' || k else '未提供仲裁理由' end as reason from k""")
def q_arbitration_normalise(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    flag = F.when(k % 4 == 0, "true").when(k % 4 == 1, '"false"').when(k % 4 == 2, "null").otherwise('"Y"')
    reason = F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"))).otherwise(" ")
    payload = F.format_string('{"is_relevant":%s,"reason":"%s"}', flag, reason)
    return read(spark, sf, "events").select("event_id", F.inline(F.array(modeljson.ruling(payload))))


@query("""with k as (select event_id, event_type, regexp_extract(props, '-?\\d+')::bigint k from events)
select event_id, 2 as n_keys, k as total from k""")
def q_usage_compact(spark, sf):
    k = F.get_json_object("props", "$.k")
    usage = F.create_map(F.lit("total_tokens"), k, F.lit("prompt_tokens"), F.lit("1"), F.lit("prompt_tokens_details"), F.lit("{}"), F.lit("completion_tokens_details"), F.lit("{}"))
    c = modeljson.compact_usage(usage)
    return read(spark, sf, "events").select("event_id", F.size(c).alias("n_keys"), F.try_element_at(c, F.lit("total_tokens")).cast("bigint").alias("total"))


# ---- screening


@query(f"with recursive {_VERDICTS} select doc_id, b::int as batch, 'batch_' || printf('%06d', b + 1) || '::' || theme as batch_theme_key from c")
def q_candidate_pairs(spark, sf):
    b = screen.document_batches(read(spark, sf, "documents"))
    wide = b.select("doc_id", "batch", "batch_text", "char_count", F.explode(screen.themes_array()).alias("th"))
    one, two = screen.coarse_flags(F.col("batch_text"), F.col("char_count"), F.col("th.theme"))
    # both screeners in one pass: an answer of flags for each batch and screener
    both = wide.select("doc_id", "batch", F.explode(F.array(one, two)).alias("hit"), F.col("th.theme").alias("theme")).where("hit").drop("hit")
    pairs = screening.candidate_pairs(both)
    return pairs.select("doc_id", "batch", F.concat_ws("::", F.format_string("batch_%06d", F.col("batch") + 1), "theme").alias("batch_theme_key"))


@query(f"with recursive {_VERDICTS} select piece_id, theme, l1 as is_relevant, case when l1 then 'rule' else 'NA' end as reason, false as needs_manual_review, 'llm1' as slot from v")
def q_targeted_flatten(spark, sf):
    # each candidate answered twice; the later answer counts
    pairs = screen.candidates(screen.document_batches(read(spark, sf, "documents")))
    result = F.transform("pieces", lambda p: F.struct(F.format_string("%08d-%05d", "doc_id", p["pos"]).alias("piece_id"), F.lower(p["t"]).contains(F.col("theme")).alias("is_relevant"), F.when(F.lower(p["t"]).contains(F.col("theme")), "rule").otherwise("NA").alias("reason")))
    stale = F.transform("pieces", lambda p: F.struct(F.format_string("%08d-%05d", "doc_id", p["pos"]).alias("piece_id"), F.lit(True).alias("is_relevant"), F.lit("stale").alias("reason")))
    rows = pairs.select("doc_id", "theme", F.lit("ok").alias("status"), F.posexplode(F.array(stale, result)).alias("ord", "results"))
    return screening.flatten_targeted(rows, ["doc_id"], "llm1").drop("doc_id")


def _pairs(spark, sf):
    v = screen.verdicts(screen.candidates(screen.document_batches(read(spark, sf, "documents"))))
    keys = ["piece_id", "theme", "n"]
    return adjudicate.pair_verdicts(screen.side(v, "l1", keys), screen.side(v, "l2", keys), keys)


@query(f"with recursive {_VERDICTS} select piece_id, theme, 'llm1: rule | llm2: rule' as note from v where l1 and l2")
def q_consensus(spark, sf):
    return adjudicate.consensus(_pairs(spark, sf)).select("piece_id", "theme", adjudicate.note(F.col("llm1_result.reason"), F.col("llm2_result.reason")).alias("note"))


@query(f"with recursive {_VERDICTS} select piece_id || '::' || theme as dispute_key, l1 as llm1, l2 as llm2 from v where l1 <> l2")
def q_disputes(spark, sf):
    return adjudicate.disputes(_pairs(spark, sf)).select("dispute_key", F.col("llm1_result.is_relevant").alias("llm1"), F.col("llm2_result.is_relevant").alias("llm2"))


@query("select doc_id, case when quality = 1 and toxic = 1 then 'consensus' else 'dispute' end as outcome from labels where quality = 1 or toxic = 1")
def q_label_adjudication(spark, sf):
    # two independent labels as two judges
    v = read(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("l1"), (F.col("toxic") == 1).alias("l2"))
    p = adjudicate.pair_verdicts(screen.side(v, "l1", ["doc_id"]), screen.side(v, "l2", ["doc_id"]), ["doc_id"])
    agreed = F.col("llm1_result.is_relevant") & F.col("llm2_result.is_relevant")
    return p.select("doc_id", F.when(agreed, "consensus").otherwise("dispute").alias("outcome"))


@query(f"with recursive {_FINAL} select piece_id, theme, note from fin where judgment = 'arbitrated'")
def q_arbitration_keep(spark, sf):
    p = _pairs(spark, sf)
    d = adjudicate.disputes(p)
    rulings = d.select("dispute_key", (F.col("n") % 2 == 0).alias("is_relevant"), F.lit("rule").alias("reason"))
    return adjudicate.final_records(adjudicate.consensus(p), d, rulings, ["piece_id", "theme"]).where("judgment = 'arbitrated'").select("piece_id", "theme", "note")


@query(f"with recursive {_FINAL} select doc_id, piece_id, theme, n::int as n, judgment, note from fin")
def q_final_records(spark, sf):
    return screen.final_records(read(spark, sf, "documents")).select("doc_id", "piece_id", "theme", "n", "judgment", "note")


@query(f"""with recursive {_FINAL} select piece_id, theme as matched_theme, md5('  - piece_id: ' || piece_id || chr(10) || '    source_file: ' || source || chr(10) || '    matched_theme: ' || case when theme = 'by the' then '"by the"' else theme end || chr(10) || '    judged: "' || note || '"') as yaml_md5 from fin""")
def q_primary_corpus(spark, sf):
    r = screen.final_records(read(spark, sf, "documents"), ("source",)).withColumnsRenamed({"theme": "matched_theme", "source": "source_file"})
    # the records of two runs, of which the later holds
    both = r.select("piece_id", "source_file", "matched_theme", F.explode(F.array(F.struct(F.lit(1).alias("run"), F.lit("old").alias("judged")), F.struct(F.lit(2).alias("run"), F.col("note").alias("judged")))).alias("x")).select("piece_id", "source_file", "matched_theme", "x.*")
    merged = adjudicate.merge_records(both, "run")
    return corpus_yaml.record_yaml(merged, ["piece_id", "source_file", "matched_theme", "judged"]).select("piece_id", "matched_theme", F.md5("yaml").alias("yaml_md5"))


@query(f"with recursive {_FINAL} select source as target, count(*) as final_count, count(distinct piece_id) as piece_count, count(*) filter (judgment = 'arbitrated') as arbitrated_keep_count, 0::bigint as manual_review_count from fin group by 1")
def q_target_summary(spark, sf):
    return adjudicate.target_summary(screen.final_records(read(spark, sf, "documents"), ("source",)), "source").withColumnRenamed("source", "target")


_STATE_SQL = f"""with recursive {_FINAL}, t as (select source target, count(distinct lang) repo_dir_count from documents group by 1),
n as (select source target, 'f' k, count(*) n from f group by 1 union all select d.source, 'b', count(*) from bt join documents d using (doc_id) group by 1
 union all select d.source, 'p', count(*) from c join documents d using (doc_id) group by 1 union all select source, 'c', count(*) from v where l1 and l2 group by 1
 union all select source, 'd', count(*) from v where l1 <> l2 group by 1 union all select source, 'r', count(*) from fin group by 1
 union all select source, 'i', count(distinct piece_id) from fin group by 1 union all select source, 'a', count(*) from fin where judgment = 'arbitrated' group by 1)
select target, repo_dir_count, coalesce(sum(n) filter (k = 'f'), 0)::bigint as fragment_count, coalesce(sum(n) filter (k = 'b'), 0)::bigint as batch_count, coalesce(sum(n) filter (k = 'p'), 0)::bigint as candidate_pair_count,
 coalesce(sum(n) filter (k = 'c'), 0)::bigint as consensus_count, coalesce(sum(n) filter (k = 'd'), 0)::bigint as dispute_count, 0::bigint as manual_review_count, coalesce(sum(n) filter (k = 'r'), 0)::bigint as final_record_count,
 coalesce(sum(n) filter (k = 'i'), 0)::bigint as final_piece_count, coalesce(sum(n) filter (k = 'a'), 0)::bigint as arbitrated_keep_count from t left join n using (target) group by target, repo_dir_count"""


@query(_STATE_SQL)
def q_target_state(spark, sf):
    d = read(spark, sf, "documents").withColumn("target", F.col("source"))
    b = screen.document_batches(d, ("target",))
    pairs = screen.candidates(b)
    v = screen.verdicts(pairs, ("target",))
    parts = {
        "repo_dir_count": d.select("target", "lang").distinct(), "fragment_count": b.select("target", F.explode("pieces")), "batch_count": b, "candidate_pair_count": pairs,
        "consensus_count": v.where("l1 and l2"), "dispute_count": v.where("l1 <> l2"), "manual_review_count": v.where("false"),
    }
    return adjudicate.full_summary(parts, screen.final_records(d, ("target",)))


class _Rules:
    """The rule screeners of `screen` as models that answer in JSON: 1 and 2 judge, 3 rules; some targets get no answer."""

    local = True

    def __init__(self, which: int, silent: F.Column | None = None):
        self.which, self.silent, self.model = which, silent, f"rules{which}"

    def screen(self, requests: DataFrame) -> DataFrame:
        r = requests if self.silent is None else requests.where(~self.silent)
        yes = lambda c: F.when(c, "T").otherwise("F")
        if "batch_text" in r.columns:
            flags = [(F.lit(str(i)), yes(screen.coarse_flags(F.col("batch_text"), F.col("char_count"), F.lit(t))[self.which - 1])) for i, t in screen.THEMES]
            payload = F.to_json(F.create_map(*(x for pair in flags for x in pair)))
        elif "pieces" in r.columns:
            judged = lambda p: screen.targeted_flags(p["original_text"], F.length(p["original_text"]), F.col("theme"))[self.which - 1]
            payload = F.to_json(F.struct(F.transform("pieces", lambda p: F.struct(p["piece_id"].alias("piece_id"), yes(judged(p)).alias("is_relevant"), F.lit("rule").alias("reason"))).alias("results")))
        else:
            payload = F.to_json(F.struct((F.length("original_text") % 2 == 0).alias("is_relevant"), F.lit("rule").alias("reason")))
        return screening.RuleScreener(payload).screen(r)


@query(_STATE_SQL)
def q_run_commits(spark, sf):
    # the resumable run over all documents: the second judge is silent for half of the targets, so these fail; a second run
    # finishes them and takes the others over from the commit table, whose counts are the result
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("target"), F.col("lang").alias("repo_dir"), "text")
    f = d.select("target", "repo_dir", F.col("doc_id").cast("string").alias("source_file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    f = f.withColumn("original_text", F.trim("line")).where("original_text <> ''")
    f = f.select("target", (F.col("doc_id") * (1 << 24) + F.col("pos")).alias("ord"), F.format_string("%08d-%05d", "doc_id", "pos").alias("piece_id"), "source_file", "repo_dir", "original_text")
    folder, themes = scratch_dir(spark), [t for _, t in screen.THEMES]
    judges = {"llm1": _Rules(1), "llm2": _Rules(2, F.crc32("target") % 2 == 0), "llm3": _Rules(3)}
    with contextlib.suppress(job.Paused):
        job.run(spark, f, themes, judges, folder)
    out = job.run(spark, f, themes, judges | {"llm2": _Rules(2)}, folder)
    return out.summary.drop("is_completed", "updated_at")


@query(f"with recursive {_FINAL} select piece_id, theme as matched_theme, source as target, judgment, note from fin")
def q_project_records(spark, sf):
    # written as JSON lines, a folder for each target, and read back over all targets
    r = screen.final_records(read(spark, sf, "documents"), ("source",)).withColumnsRenamed({"theme": "matched_theme", "source": "target"})
    path = scratch_dir(spark)
    record_files.write_records(r.select("target", "piece_id", "matched_theme", "judgment", "note"), path)
    return record_files.project_records(spark, path, "piece_id string, matched_theme string, judgment string, note string")


@query(f"""with {_LINES} select 'targeted::' || doc_id || '::' || printf('%08d-%05d', doc_id, pos) as manual_review_key, source as source_file, 'by the / ment / der' as theme_line, '自动兜底失败，需人工审核。short' as manual_review_reason, md5(t) as text_md5
from f join (select doc_id from documents where length(text) < 500) using (doc_id)""")
def q_manual_review(spark, sf):
    e = _review(spark, sf)
    return e.select("manual_review_key", "source_file", review.theme_line(F.col("matched_theme"), F.col("candidate_themes")).alias("theme_line"), "manual_review_reason", F.md5("original_text").alias("text_md5"))


def _review(spark, sf):
    # documents under 500 characters stand for requests that no model could answer
    d = read(spark, sf, "documents")
    f = fragments.line_fragments(d).join(d.select("doc_id", F.col("source").alias("source_file")), "doc_id")
    rows = d.select(F.col("doc_id").cast("string").alias("key"), F.lit("").alias("source_file"), F.lit(None).cast("string").alias("theme"), F.array(*(F.lit(t) for _, t in screen.THEMES)).alias("themes"), F.when(F.length("text") < 500, "manual").otherwise("ok").alias("status"), F.lit("short").alias("error"), F.col("doc_id").alias("_d"))
    ids = f.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list("piece_id").alias("piece_ids"))
    return review.review_entries(rows.join(ids, "_d"), f, "targeted")


@query(f"""with {_LINES}, e as (select 'targeted::' || doc_id || '::' || printf('%08d-%05d', doc_id, pos) k, printf('%08d-%05d', doc_id, pos) piece, source, lang, t from f join (select doc_id from documents where length(text) < 500) using (doc_id))
select row_number() over (order by k) as section, k as manual_review_key, md5('## ' || row_number() over (order by k) || '. ' || piece || ' | targeted | by the / ment / der' || chr(10) || chr(10) || '- 文献: ' || source || chr(10) || '- 目录: ' || lang || chr(10) || '- 原因: 自动兜底失败，需人工审核。short'
  || chr(10) || '- 候选主题: by the; ment; der' || chr(10) || chr(10) || '```text' || chr(10) || t || chr(10) || '```' || chr(10)) as markdown_md5 from e""")
def q_review_report(spark, sf):
    e = _review(spark, sf)
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("_d"), F.col("lang").alias("repo_dir"))
    e = e.withColumn("_d", F.split("manual_review_key", "::")[1]).join(d, "_d").drop("_d")
    out = corpus_yaml.review_sections(ordered.ranked(e, ["manual_review_key"], "section"), "section")
    return out.select("section", "manual_review_key", F.md5("markdown").alias("markdown_md5"))


@query(f"with recursive {_FINAL} select row_number() over (order by piece_id, theme) as place, piece_id, theme as matched_theme, judgment from fin")
def q_ordered_records(spark, sf):
    r = screen.final_records(read(spark, sf, "documents")).withColumnRenamed("theme", "matched_theme").select("piece_id", "matched_theme", "judgment")
    return ordered.ranked(r, ["piece_id", "matched_theme"], "place")


@query(f"with recursive {_VERDICTS}, w as (select doc_id, b, theme from c where doc_id % 3 <> 0) select row_number() over (order by doc_id, b, case theme when 'by the' then 1 when 'ment' then 2 else 3 end) as place, doc_id, b::int as batch, theme from w")
def q_ordered_pairs(spark, sf):
    # answers to all pairs, of which two documents in three are asked for: in the order of batch and theme, others left out
    c = screen.candidates(screen.document_batches(read(spark, sf, "documents"))).withColumn("key", F.concat_ws("::", "doc_id", "batch", "theme"))
    number = F.element_at(F.create_map(*(x for i, t in screen.THEMES for x in (F.lit(t), F.lit(i)))), F.col("theme"))
    work = c.where("doc_id % 3 <> 0").select("key", "doc_id", "batch", number.alias("theme_no"))
    return ordered.in_work_order(c.select("key", "theme"), work, "key", ["doc_id", "batch", "theme_no"]).select("place", "doc_id", "batch", "theme")


@query("select doc_id from documents where lang <> 'en'")
def q_resume_pending(spark, sf):
    # English documents are answered already, and stand in the response log
    requests = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.md5("text").alias("prompt"), "lang")
    log = ResponseLog(spark, scratch_dir(spark))
    log.ask(screening.RuleScreener(F.lit("{}")), requests.where("lang = 'en'"), "coarse", "llm1", "mark")
    return log.pending(requests, "coarse", "llm1", "mark").select(F.col("key").cast("bigint").alias("doc_id"))


@query("select e.event_id, f.event_id as last_event, f.event_type as payload from events e join (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) f on f.user_id = e.user_id and rn = 1")
def q_replay_answers(spark, sf):
    # a user's last event is the recorded answer to all requests of the user
    e = read(spark, sf, "events")
    key = F.col("user_id").cast("string").alias("key")
    log = e.select(key, F.lit("ok").alias("status"), F.to_json(F.struct("event_id", "event_type")).alias("payload"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"), F.struct("ts", "event_id").alias("ord"))
    got = screening.ReplayScreener(log).screen(e.select(key, "event_id"))
    answers = got.select("key", "payload").distinct()
    out = e.select("event_id", key).join(answers, "key")
    return out.select("event_id", F.get_json_object("payload", "$.event_id").cast("bigint").alias("last_event"), F.get_json_object("payload", "$.event_type").alias("payload"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def q_dedupe_first(spark, sf):
    return dedupe.first_wins(read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def q_dedupe_last(spark, sf):
    return dedupe.last_wins(read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


# ---- progress, citations, workspace


def action_log(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    action = F.element_at(F.array(*(F.lit(a) for a in ("start", "checkpoint", "complete", "pause", "start", "complete"))), (F.pmod(F.col("event_id"), F.lit(6)) + 1).cast("int"))
    target = F.element_at(F.array(F.lit("KR1a"), F.lit("KR2b"), F.lit(""), F.lit("KR9z")), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    return events.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), action.alias("action"), target.alias("target"), (k % 5).alias("delta"))


@query("""
with recursive k as (select user_id project, event_id seq, ['start', 'checkpoint', 'complete', 'pause', 'start', 'complete'][event_id % 6 + 1] act, regexp_extract(props, '-?\\d+')::bigint k from events),
a as (select project, row_number() over (partition by project order by seq) rn, act, ['KR1a', 'KR2b', '', 'KR9z'][k % 4 + 1] tgt, k % 5 delta from k),
r as (select distinct project, 0::bigint rn, 'pending' status, []::varchar[] done, '' cur, 0::bigint runs, 0::bigint pieces, 0::bigint errors from k union all
  select project, rn, case when not ok then status when len(done2) = 3 then 'completed' when cur3 <> '' then case when act = 'pause' then 'paused' else 'running' end
                           when len(done2) > 0 then case when act in ('start', 'checkpoint') then 'running' else 'paused' end else 'pending' end,
         done2, case when ok then cur3 else cur end, runs + (ok and act = 'start' and chosen <> cur)::bigint, pieces + case when ok then delta else 0 end, errors + (not ok)::bigint
  from (select *, case when list_contains(done2, cur2) then '' else cur2 end cur3 from (select *, case when ok and act = 'complete' and not list_contains(done, chosen) then list_append(done, chosen) else done end done2,
          case when act = 'complete' then '' when act = 'pause' then coalesce(chosen, '') else chosen end cur2
    from (select *, tgt <> 'KR9z' and (act = 'pause' or (chosen is not null and (act = 'complete' or not list_contains(done, chosen)))) ok
      from (select r.project, a.rn, r.status, r.done, r.cur, r.runs, r.pieces, r.errors, a.act, a.tgt, a.delta,
              coalesce(nullif(a.tgt, ''), nullif(r.cur, ''), case when a.act = 'start' then list_filter(['KR1a', 'KR2b', 'KR3c'], lambda t: not list_contains(r.done, t) and t <> r.cur)[1] end) chosen
            from r join a on a.project = r.project and a.rn = r.rn + 1)))))
select project, status, cur as "current", len(done)::bigint as n_completed, '' as "cursor", '' as last_piece, '' as note, runs as run_count, pieces as piece_count, errors
from r qualify row_number() over (partition by project order by rn desc) = 1""")
def q_progress_replay(spark, sf):
    return progress.replay(action_log(read(spark, sf, "events")), ("KR1a", "KR2b", "KR3c"))


@query("""with s as (select distinct p_partkey seed from part where p_size = 7), e as (select distinct l_orderkey citing, l_partkey cited from lineitem)
select citing as work, string_agg(cited::varchar, ',' order by cited) as parents, count(*) as n_parents, 1 as discovered_round, 'cited_by' as discovered_via from e join s on cited = seed group by citing""")
def q_citation_cited_by(spark, sf):
    seeds = read(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("seed_ord"), F.col("p_partkey").alias("seed"))
    edges = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    return citations.expand(seeds, edges, 1, "cited_by").withColumn("parents", F.array_join("parents", ","))


@query("""with s as (select o_orderkey seed from orders where o_orderpriority = '1-URGENT'), e as (select distinct l_orderkey citing, l_partkey cited from lineitem)
select cited as work, string_agg(citing::varchar, ',' order by citing) as parents, count(*) as n_parents, 2 as discovered_round, 'referenced_works' as discovered_via from e join s on citing = seed group by cited""")
def q_citation_references(spark, sf):
    seeds = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("seed_ord"), F.col("o_orderkey").alias("seed"))
    edges = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    return citations.expand(seeds, edges, 2, "referenced_works").withColumn("parents", F.array_join("parents", ","))


@query("select item_id, array_to_string(regexp_split_to_array(trim(text), '\\s+'), ' ') as abstract from benchmark")
def q_openalex_abstract(spark, sf):
    # the text as an inverted index, and back
    words = F.split(F.trim("text"), r"\s+")
    t = read(spark, sf, "benchmark").select("item_id", F.posexplode(words).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("at"))
    index = t.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("item_id", citations.abstract(F.col("index")).alias("abstract"))


@query("""select page_id, 'openalex' as source, 'W' || page_id as openalex_id, case when page_id % 3 = 0 then '' else '10.1/' || page_id end as doi, url as title, (2000 + page_id % 20)::int as year,
'article' as type, case when page_id % 4 = 0 then '' else 'Li ' || page_id % 5 || '|Wang' end as authors, case when page_id % 2 = 0 then 'J ' || page_id % 7 else '' end as journal, 'w' || page_id % 7 || ' x w' || page_id % 7 as abstract, (page_id % 11)::int as cited_by_count from pages""")
def q_openalex_works(spark, sf):
    # every page as the JSON of a work
    name = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    k = F.col("page_id")
    word = F.concat(F.lit("w"), (k % 7).cast("string"))
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), k.cast("string")).alias("id"), F.when(k % 3 != 0, F.concat(F.lit("https://doi.org/10.1/"), k.cast("string"))).alias("doi"), F.col("url").alias("display_name"),
        (2000 + k % 20).alias("publication_year"), F.lit("article").alias("type"), F.when(k % 4 != 0, F.array(name(F.concat(F.lit("Li "), (k % 5).cast("string"))), name(F.lit("Wang")))).alias("authorships"),
        F.struct(F.when(k % 2 == 0, F.struct(F.concat(F.lit("J "), (k % 7).cast("string")).alias("display_name"))).alias("source")).alias("primary_location"),
        F.create_map(word, F.array(F.lit(0), F.lit(2)), F.lit("x"), F.array(F.lit(1))).alias("abstract_inverted_index"), (k % 11).alias("cited_by_count"),
    )
    out = citations.normalize_works(read(spark, sf, "pages").select("page_id", F.to_json(work).alias("payload")))
    return out.drop("id").withColumn("authors", F.array_join("authors", "|"))


@query("""with w as (select distinct p_partkey seed, l_orderkey work from part join lineitem on l_partkey = p_partkey where p_size = 7)
select 'cites:W' || seed as "filter", ((row_number() over (partition by seed order by work) - 1) // 50 + 1)::int as page, ((row_number() over (partition by seed order by work) - 1) % 50)::int as pos,
       'W' || work as openalex_id, 'work ' || work as title, (work % 5)::int as cited_by_count from w""")
def q_work_pages(spark, sf):
    # works that cite the seeds, recorded as pages of 50, read by the data source without a network
    seeds = read(spark, sf, "part").where("p_size = 7").select("p_partkey")
    cites = read(spark, sf, "lineitem").join(seeds, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "l_orderkey").distinct()
    work = F.struct(F.concat(F.lit("https://openalex.org/W"), "l_orderkey").alias("id"), F.concat(F.lit("work "), "l_orderkey").alias("display_name"), (F.col("l_orderkey") % 5).alias("cited_by_count"))
    every = cites.select(F.concat(F.lit("cites:W"), "p_partkey").alias("filter"), "l_orderkey", F.to_json(work).alias("payload"))
    placed = ordered.running_sum(every.withColumn("one", F.lit(1)), ["filter"], "l_orderkey", "one", "upto").select("filter", (F.col("upto") - 1).alias("at"), "payload")
    folder = scratch_dir(spark)
    work_pages.record(placed, folder)
    spark.dataSource.register(work_pages.WorkPages)
    filters = json.dumps([f"cites:W{r[0]}" for r in seeds.collect()])  # what a user asks for
    pages = spark.read.format("work_pages").option("filters", filters).option("replay", folder).load()
    return citations.normalize_works(pages).select("filter", "page", "pos", "openalex_id", "title", "cited_by_count")


@query("select page_id, 'W' || page_id as work, '10.1/' || page_id as doi from pages")
def q_work_ids(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.concat(F.lit("https://openalex.org/W"), "page_id").alias("id"), F.concat(F.lit("https://doi.org/10.1/"), "page_id").alias("d"))
    return p.select("page_id", citations.work_id(F.col("id")).alias("work"), citations.doi(F.col("d")).alias("doi"))


_REQUIRED_SQL = ", ".join(f"({s}, '{p}', {i})" for i, (s, p) in enumerate(workspace.REQUIRED))
_STATUS_SQL = f"""with req(stage, path, i) as (values {_REQUIRED_SQL}), have as (select distinct user_id project, path from events join req on i = regexp_extract(props, '-?\\d+')::bigint % {len(workspace.REQUIRED)}),
st as (select project, stage, count(h.path) found, count(*) n from (select distinct user_id project from events) cross join req left join have h using (project, path) group by all),
s as (select project, stage, case when found = n then 'complete' when found > 0 then 'partial' else 'missing' end status, n - found n_missing from st)"""


def _workspace(spark, sf):
    required = spark.createDataFrame([(s, p) for s, p in workspace.REQUIRED], "stage int, path string")
    paths = F.array(*(F.lit(p + "paper.pdf" if p.endswith("/") else p) for _, p in workspace.REQUIRED))
    k = F.get_json_object("props", "$.k").cast("bigint")
    present = read(spark, sf, "events").select(F.col("user_id").alias("project"), F.element_at(paths, (F.pmod(k, F.lit(len(workspace.REQUIRED))) + 1).cast("int")).alias("path"))
    return workspace.stage_status(required, present)


@query(f"{_STATUS_SQL} select * from s")
def q_workspace_status(spark, sf):
    return _workspace(spark, sf)


@query(f"{_STATUS_SQL} select project, coalesce(min(stage) filter (status <> 'complete'), 7) - 1 as highest_completed_stage, min(stage) filter (status <> 'complete') as next_stage from s group by 1")
def q_workspace_next(spark, sf):
    return workspace.next_stage(_workspace(spark, sf))
