"""Models' JSON answers, read without ever failing a job: each reader gives a status next to its value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import theme_ref, to_bool
from .pytext import bind, strip

# fixed values
NO_REASON, NOT_APPLICABLE, NO_RULING = "未提供相关理由", "NA", "未提供仲裁理由"
MANUAL = "MANUAL_REVIEW_REQUIRED"

OBJECT = "map<string,string>"
RESULTS = "struct<results:array<struct<piece_id:string,is_relevant:string,reason:string>>>"
THEMES = "struct<themes:array<struct<theme:string,theme_id:string,index:string,is_relevant:string>>>"


def _parsed(c: Column) -> Column:
    # a broken text parses to a null or empty map unless it really is an object
    return F.when(F.json_object_keys(c).isNotNull(), c)


def json_object(c: Column) -> Column:
    """The JSON object in an answer, as text, or null: fences go, then the whole is tried, then the part from the first { to the last }."""
    body = strip(F.regexp_replace(strip(c), r"(?im)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(_parsed(body), _parsed(F.when(inner != "", inner)))


def coarse(payload: Column, names: Column, by_index: Column) -> Column:
    """struct(status, themes array<struct<theme, is_relevant>>) in the themes' order.

    Either a list under "themes" or flags by name or number; the first mention of a theme holds, missing
    and unreadable flags are false. Flat objects that name no theme are a format error, empty ones are not.
    """
    def read_payload(payload: Column) -> Column:
        is_list = F.coalesce(F.startswith(F.ltrim(F.get_json_object(payload, "$.themes")), F.lit("[")), F.lit(False))
        ref = lambda x: F.coalesce(F.nullif(x["theme"], F.lit("")), F.nullif(x["theme_id"], F.lit("")), x["index"])
        mention = lambda r, flag: F.struct(theme_ref(r, names, by_index, True).alias("theme"), to_bool(flag, True).alias("flag"))
        listed = F.transform(F.from_json(payload, THEMES)["themes"], lambda x: mention(ref(x), x["is_relevant"]))
        flat = F.transform(F.map_entries(F.from_json(payload, OBJECT)), lambda x: mention(x["key"], x["value"]))
        read = F.struct(is_list.alias("is_list"), F.coalesce(F.when(is_list, listed).otherwise(flat), F.array().cast("array<struct<theme:string,flag:boolean>>")).alias("all"))

        def judge(r: Column) -> Column:
            said = F.filter(r["all"], lambda x: x["theme"].isNotNull())
            first = lambda t: F.get(F.filter(r["all"], lambda x: x["theme"] == t), F.lit(0))["flag"]
            judged = F.transform(names, lambda t: F.struct(t.alias("theme"), F.coalesce(first(t), F.lit(False)).alias("is_relevant")))
            bad = payload.isNull() | (~r["is_list"] & (F.size(r["all"]) > 0) & (F.size(said) == 0))
            return F.struct(F.when(bad, "format_error").otherwise("ok").alias("status"), F.when(~bad, judged).alias("themes"))

        return bind(read, judge)

    return bind(payload, read_payload)


def targeted(payload: Column, piece_ids: Column) -> Column:
    """struct(status, results array<struct<piece_id, is_relevant, reason>>) for each expected piece, in order.

    A mentioned piece is relevant unless a flag says it isn't; the first such mention gives the reason.
    """
    def read_payload(payload: Column) -> Column:
        good = F.coalesce(F.startswith(F.ltrim(F.get_json_object(payload, "$.results")), F.lit("[")), F.lit(False))
        hits = F.filter(F.from_json(payload, RESULTS)["results"], lambda x: F.coalesce(to_bool(x["is_relevant"], True), F.lit(True)))
        hits = F.transform(hits, lambda x: F.struct(strip(x["piece_id"]).alias("id"), F.coalesce(F.nullif(strip(x["reason"]), F.lit("")), F.lit(NO_REASON)).alias("reason")))

        def judge(h: Column) -> Column:
            first = lambda p: F.get(F.filter(h, lambda x: x["id"] == p), F.lit(0))["reason"]
            return F.transform(piece_ids, lambda p: bind(first(p), lambda r: F.struct(p.alias("piece_id"), r.isNotNull().alias("is_relevant"), F.coalesce(r, F.lit(NOT_APPLICABLE)).alias("reason"))))

        return F.struct(F.when(good, "ok").otherwise("format_error").alias("status"), F.when(good, bind(hits, judge)).alias("results"))

    return bind(payload, read_payload)


def ruling(payload: Column) -> Column:
    """struct(is_relevant, reason) of an arbiter; flags are read like the screeners', unreadable ones are false."""
    flag = bind(F.get_json_object(payload, "$.is_relevant"), lambda f: F.coalesce(to_bool(f), F.lit(False)))
    reason = F.coalesce(F.nullif(strip(F.get_json_object(payload, "$.reason")), F.lit("")), F.lit(NO_RULING))
    return F.struct(flag.alias("is_relevant"), reason.alias("reason"))


def compact_usage(usage: Column) -> Column:
    """A usage map without the nested details of single platforms."""
    return F.map_filter(usage, lambda k, v: ~k.isin("prompt_tokens_details", "completion_tokens_details"))
