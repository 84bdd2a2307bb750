"""Corpus overview: sizes per target, totals, merges, and the estimate of the run's duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import length_without_breaks
from .batches import LIMIT, batch_count

COUNTS = ["repo_dir_count", "text_file_count", "text_char_count", "fragment_count", "batch_count"]
# fixed values
REQUEST_SECONDS, TARGETED_SHARE, UPPER = 20, 0.01, 1.5


def measure_files(fragments: DataFrame, by: list[str], order: str, limit: int = LIMIT) -> DataFrame:
    """(by, chars, fragments, batches) for each file, whose lengths meet in one row: a file is one text."""
    n = length_without_breaks(F.col("original_text"))
    lengths = F.transform(F.array_sort(F.collect_list(F.struct(order, n.alias("n")))), lambda x: x["n"])
    files = fragments.groupBy(*by).agg(lengths.alias("_n"))
    total = F.aggregate("_n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return files.select(*by, total.alias("chars"), F.size("_n").cast("bigint").alias("fragments"), batch_count(F.col("_n"), limit).alias("batches"))


def estimated_batches(batches: Column, files: Column, chars: Column, limit: int = LIMIT) -> Column:
    """The count itself, or what files and characters need at least."""
    return F.when(batches > 0, batches).when((files > 0) | (chars > 0), F.greatest(files, F.ceil(chars / limit))).otherwise(0).cast("bigint")


def target_overview(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(token, level, counts) for targets (token, level, repo_dirs) over files (repo_dir, text_file, chars, fragments, batches).

    Targets without files stay, with zeros.
    """
    wide = targets.select("token", "level", F.size("repo_dirs").cast("bigint").alias("repo_dir_count"), F.explode_outer("repo_dirs").alias("repo_dir"))
    joined = wide.join(files, "repo_dir", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(a) for c, a in (("chars", "text_char_count"), ("fragments", "fragment_count"), ("batches", "_b"))]
    out = joined.groupBy("token", "level", "repo_dir_count").agg(F.count("text_file").alias("text_file_count"), *sums)
    batches = estimated_batches(F.col("_b"), F.col("text_file_count"), F.col("text_char_count")).alias("batch_count")
    return out.select("token", "level", "repo_dir_count", "text_file_count", "text_char_count", "fragment_count", batches)


def overview_total(overview: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: sums over the targets; a directory in two targets counts once."""
    dirs = targets.select(F.explode("repo_dirs").alias("d")).agg(F.countDistinct("d").alias("repo_dir_count"))
    return dirs.crossJoin(overview.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS[1:])))  # two single rows


def merge_overviews(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Targets of both, the incoming row where both have one."""
    return previous.join(incoming.select("token"), "token", "left_anti").unionByName(incoming)


def merged_total(overview: DataFrame) -> DataFrame:
    return overview.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS))


def _phase(requests: Column, workers: int, seconds: int) -> Column:
    return F.ceil(requests / max(1, workers)) * max(1, seconds)


def timing(overview: DataFrame, llm1_workers: int, llm2_workers: int, seconds: int = REQUEST_SECONDS, share: float = TARGETED_SHARE, limit: int = LIMIT, total: DataFrame | None = None) -> DataFrame:
    """(token, batch_count, fragment_count, targeted_batch_count, lower_bound_seconds) for each target.

    total: one row of COUNTS, which stands as a target (token "") where there are no targets.
    """
    if total is not None:
        alone = total.join(overview.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti")  # one row against one at most
        overview = overview.unionByName(alone.select(F.lit("").alias("token"), *COUNTS), allowMissingColumns=True)
    b = overview.withColumn("batch_count", estimated_batches(F.col("batch_count"), F.col("text_file_count"), F.col("text_char_count"), limit))
    fragments = F.when(F.col("fragment_count") > 0, F.col("fragment_count")).otherwise(F.greatest("text_file_count", "batch_count"))
    b = b.withColumn("fragment_count", fragments).withColumn("targeted_batch_count", F.ceil(F.col("batch_count") * max(0.0, share)).cast("bigint"))
    lower = sum((_phase(F.col(c), w, seconds) for c in ("batch_count", "targeted_batch_count") for w in (llm1_workers, llm2_workers)), F.lit(0))
    return b.select("token", "batch_count", "fragment_count", "targeted_batch_count", lower.cast("bigint").alias("lower_bound_seconds"))


def timing_total(estimate: DataFrame, upper: float = UPPER) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("batch_count", "fragment_count", "targeted_batch_count", "lower_bound_seconds")]
    return estimate.agg(*sums).withColumn("upper_bound_seconds", F.ceil(F.col("lower_bound_seconds") * upper).cast("bigint"))
