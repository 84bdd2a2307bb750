"""Manual review: what no model could answer, one entry for each piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value
REASON_PREFIX = "自动兜底失败，需人工审核。"


def review_entries(rows: DataFrame, fragments: DataFrame, stage: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, manual_review_key, stage, piece_id, source_file, matched_theme, candidate_themes, reason, original_text).

    rows: key, piece_ids, source_file, theme, themes, status, error; those with status manual count. The fragment's own
    source and text are preferred to the row's. by: columns that, with piece_id, name a fragment, such as the target.
    """
    r = rows.where("status = 'manual'").select(*by, "key", "source_file", "theme", "themes", "error", F.explode("piece_ids").alias("piece_id"))
    f = fragments.select(*by, "piece_id", F.col("source_file").alias("_s"), "original_text")
    r = r.join(f, [*by, "piece_id"], "left")
    reason = F.concat(F.lit(REASON_PREFIX), F.coalesce("error", F.lit("")))
    return r.select(
        *by, F.concat_ws("::", F.lit(stage), "key", "piece_id").alias("manual_review_key"), F.lit(stage).alias("manual_review_stage"), "piece_id",
        F.coalesce("_s", "source_file").alias("source_file"), F.coalesce("theme", F.lit("")).alias("matched_theme"),
        F.when(F.col("theme").isNull(), F.col("themes")).otherwise(F.array().cast("array<string>")).alias("candidate_themes"),
        reason.alias("manual_review_reason"), F.coalesce("original_text", F.lit("")).alias("original_text"),
    )


def theme_line(theme: Column, candidates: Column, unknown: str = "待人工判断主题") -> Column:
    return F.when(theme != "", theme).when(F.size(candidates) > 0, F.array_join(candidates, " / ")).otherwise(unknown)
