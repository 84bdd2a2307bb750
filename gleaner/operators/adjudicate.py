"""Adjudication: two verdict sets joined into consensus and disputes, rulings, final records and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import last_wins


def pair_verdicts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts (keys, is_relevant, reason, needs_manual_review) of both screeners, where both have one and one is positive."""
    side = lambda d, n: d.select(*keys, F.struct("is_relevant", "reason", "needs_manual_review").alias(n))
    return side(a, "llm1_result").join(side(b, "llm2_result"), keys).where("llm1_result.is_relevant or llm2_result.is_relevant")


def consensus(pairs: DataFrame) -> DataFrame:
    return pairs.where("llm1_result.is_relevant and llm2_result.is_relevant")


def disputes(pairs: DataFrame, piece: str = "piece_id", theme: str = "theme") -> DataFrame:
    out = pairs.where("llm1_result.is_relevant <> llm2_result.is_relevant")
    return out.withColumn("dispute_key", F.concat_ws("::", piece, theme))


def note(*reasons: Column) -> Column:
    return F.array_join(F.array(*(F.concat(F.lit(f"llm{i}: "), F.coalesce(r, F.lit(""))) for i, r in enumerate(reasons, 1))), " | ")


def final_records(agreed: DataFrame, disputed: DataFrame, rulings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, judgment, note, needs_manual_review): what both kept and what the arbiter kept. rulings: dispute_key, is_relevant, reason."""
    manual = lambda *cols: F.coalesce(F.greatest(*(F.coalesce(F.col(c), F.lit(False)) for c in cols)), F.lit(False)).alias("needs_manual_review")
    both = ("llm1_result.needs_manual_review", "llm2_result.needs_manual_review")
    one = agreed.select(*keys, F.lit("consensus").alias("judgment"), note(F.col("llm1_result.reason"), F.col("llm2_result.reason")).alias("note"), manual(*both))
    kept = rulings.where("is_relevant").select("dispute_key", F.col("reason").alias("_r"))
    two = disputed.join(kept, "dispute_key").select(*keys, F.lit("arbitrated").alias("judgment"), note(F.col("llm1_result.reason"), F.col("llm2_result.reason"), F.col("_r")).alias("note"), manual(*both))
    return one.unionByName(two)


def merge_records(records: DataFrame, order: str, keys: tuple[str, ...] = ("piece_id", "matched_theme")) -> DataFrame:
    """Of records for the same piece and theme the one of the last group; blank pieces go."""
    return last_wins(records.where(F.trim("piece_id") != ""), list(keys), [order]).drop(order)


def full_summary(parts: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """(target, a count for each of parts, final_record_count, final_piece_count, arbitrated_keep_count), one row per target.

    parts: name of the count -> rows with a column target. One aggregation over the union of per-target counts.
    """
    rows = None
    for name, df in parts.items():
        one = df.groupBy("target").agg(F.count(F.lit(1)).alias("n")).select("target", F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    sums = rows.groupBy("target").agg(*(F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in parts))
    found = target_summary(records).withColumnsRenamed({"final_count": "final_record_count", "piece_count": "final_piece_count"}).drop("manual_review_count")
    more = ("final_record_count", "final_piece_count", "arbitrated_keep_count")
    return sums.join(found, "target", "left").select("target", *parts, *(F.coalesce(c, F.lit(0)).alias(c) for c in more))


def target_summary(records: DataFrame, by: str = "target") -> DataFrame:
    return records.groupBy(by).agg(
        F.count(F.lit(1)).alias("final_count"),
        F.countDistinct(F.when(F.trim("piece_id") != "", F.col("piece_id"))).alias("piece_count"),
        F.count_if(F.col("judgment") == "arbitrated").alias("arbitrated_keep_count"),
        F.count_if(F.col("needs_manual_review")).alias("manual_review_count"),
    )
