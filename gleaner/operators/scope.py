"""Scope: tokens typed by a user, resolved against families and repositories of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import SPACE, strip

# fixed values
FAMILY, REPO = r"^KR[1-4][a-z]$", r"^KR[1-4][a-z]\d{4}$"
NO_FAMILY = "该类目不存在，或本地没有对应目录。"
NO_REPO = "该目录不存在。"
BAD_TOKEN = "格式不合法；仅支持 KR1a 或 KR1a0001。"
OVERLAP = ("范围重复，已经被 ", " 覆盖。")


def normalize_scope(c: Column) -> Column:
    text = strip(c)
    return F.when(F.lower(text).startswith("kr") & (F.length(text) > 2), F.concat(F.lit("KR"), F.lower(F.substr(text, F.lit(3))))).otherwise(text)


def split_tokens(c: Column) -> Column:
    """The distinct tokens of a text, in order: commas of both widths and white space part them."""
    parts = F.split(F.regexp_replace(c, "[，,]", " "), rf"(?U){SPACE}+")
    return F.array_distinct(F.filter(F.transform(parts, normalize_scope), lambda t: t != ""))


def token_level(c: Column) -> Column:
    return F.when(c.rlike(FAMILY), "family").when(c.rlike(REPO), "repo").otherwise("invalid")


def resolve_targets(tokens: DataFrame, dirs: DataFrame) -> DataFrame:
    """(ord, token, level, repo_dirs) of tokens (ord, token) that exist in dirs (repo_dir)."""
    t = tokens.withColumn("level", token_level(F.col("token")))
    dirs = dirs.where(F.col("repo_dir").rlike(REPO)).select("repo_dir").distinct()
    families = dirs.groupBy(F.substring("repo_dir", 1, 4).alias("token")).agg(F.sort_array(F.collect_list("repo_dir")).alias("repo_dirs"))
    family = t.where("level = 'family'").join(families, "token")
    repo = t.where("level = 'repo'").join(dirs.withColumnRenamed("repo_dir", "token"), "token").withColumn("repo_dirs", F.array("token"))
    return family.unionByName(repo).select("ord", "token", "level", "repo_dirs")


def scope_issues(tokens: DataFrame, dirs: DataFrame) -> DataFrame:
    """(phase, ord, token, detail): unknown and malformed tokens, then repositories that a chosen family covers."""
    t = tokens.withColumn("level", token_level(F.col("token")))
    good = resolve_targets(tokens, dirs)
    detail = F.when(F.col("level") == "family", NO_FAMILY).when(F.col("level") == "repo", NO_REPO).otherwise(BAD_TOKEN)
    missing = t.join(good.select("ord"), "ord", "left_anti").select(F.lit(0).alias("phase"), "ord", "token", detail.alias("detail"))
    families = good.where("level = 'family'").select(F.col("token").alias("family"))
    twice = good.where("level = 'repo'").withColumn("family", F.substring("token", 1, 4)).join(families, "family", "left_semi")
    twice = twice.select(F.lit(1).alias("phase"), "ord", "token", F.concat(F.lit(OVERLAP[0]), F.col("family"), F.lit(OVERLAP[1])).alias("detail"))
    return missing.unionByName(twice)


def merge_targets(a: Column, b: Column) -> Column:
    """Both lists of targets, normalised, each target once, in order."""
    return F.array_distinct(F.filter(F.transform(F.concat(a, b), normalize_scope), lambda t: t != ""))


def pending_targets(targets: Column, completed: Column, current: Column) -> Column:
    return F.filter(F.array_except(targets, completed), lambda t: ~t.eqNullSafe(current))
