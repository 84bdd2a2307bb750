"""The primary corpus as YAML, and the review queue as Markdown. Records are rendered in Spark, one text a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from ..operators.review import theme_line

#: a scalar of only these may stand bare
_BARE = r"^[\w一-鿿\-./:()%]+$"
FIELDS = ["piece_id", "source_file", "matched_theme", "original_text", "note", "needs_manual_review", "manual_review_reason"]


def scalar(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(text == "", '""').when(text.rlike(_BARE.replace(r"\w", r"\p{L}\p{N}_")), text).otherwise(quoted)


def entry(name: str, c: Column, indent: int) -> Column:
    """`name: value`; texts of several lines as a literal block."""
    text, pad = F.coalesce(c.cast("string"), F.lit("")), " " * (indent + 2)
    block = F.concat(F.lit(f"{name}: |\n{pad}"), F.replace(text, F.lit("\n"), F.lit("\n" + pad)))
    return F.when(text.contains("\n"), block).otherwise(F.concat(F.lit(f"{name}: "), scalar(c)))


def record_yaml(records: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(piece_id, matched_theme, yaml): each record as an item of the list under `records`."""
    item = F.concat(F.lit("  - "), F.array_join(F.array(*(entry(f, F.col(f), 4) for f in fields)), "\n    "))
    return records.select("piece_id", "matched_theme", item.alias("yaml"))


def write_corpus(records: DataFrame, path: str) -> None:
    """The whole corpus as one sorted set of text files: concatenated in name order they are one YAML document."""
    pieces = records.agg(F.countDistinct(F.when(F.trim("piece_id") != "", F.col("piece_id")))).first()[0]
    head = records.sparkSession.createDataFrame([("", "", f"piece_count: {pieces}\nrecords:")], "piece_id string, matched_theme string, yaml string")
    out = head.withColumn("_o", F.lit(0)).unionByName(record_yaml(records).withColumn("_o", F.lit(1)))
    out.repartitionByRange("_o", "piece_id", "matched_theme").sortWithinPartitions("_o", "piece_id", "matched_theme").select(F.col("yaml").alias("value")).write.mode("overwrite").text(path)


# fixed values
REPORT = "# Manual Review Required\n\n以下 fragment 需要人工审核。自动筛查与 fallback 均未能稳定返回可用结构化结果。\n"
NOTHING = "当前无需要人工审核的 fragment。\n"


def review_sections(entries: DataFrame, number: str | None = None) -> DataFrame:
    """(manual_review_key, markdown) of review entries, and their number where a column has one.

    Columns repo_dir, batch_id and generated_at are told where there are such.
    """
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in entries.columns else F.lit("")
    counted = F.concat(F.col(number).cast("string"), F.lit(". ")) if number else F.lit("")
    head = F.concat(F.lit("## "), counted, F.coalesce(F.nullif("piece_id", F.lit("")), F.lit("未知 piece_id")), F.lit(" | "), F.coalesce(F.nullif(c("manual_review_stage"), F.lit("")), F.lit("unknown")), F.lit(" | "), theme_line(F.col("matched_theme"), F.col("candidate_themes")))
    facts = [F.concat(F.lit(f"\n- {said}: "), c(n)) for said, n in (("目录", "repo_dir"), ("批次", "batch_id"), ("时间", "generated_at")) if n in entries.columns]
    listed = F.filter("candidate_themes", lambda t: F.trim(t) != "")
    candidates = F.when((F.coalesce("matched_theme", F.lit("")) == "") & (F.size(listed) > 0), F.concat(F.lit("\n- 候选主题: "), F.array_join(listed, "; "))).otherwise("")
    body = F.concat(head, F.lit("\n\n- 文献: "), c("source_file"), *facts, F.lit("\n- 原因: "), c("manual_review_reason"), *([candidates] if number else []), F.lit("\n\n```text\n"), c("original_text"), F.lit("\n```\n"))
    return entries.select(*([number] if number else []), "manual_review_key", body.alias("markdown"))


def write_review(entries: DataFrame, path: str, order: tuple[str, ...] = ("manual_review_key",)) -> None:
    """The review report as text files: concatenated in name order they are one document, its sections numbered 1 to n."""
    sections = review_sections(ranked(entries, list(order), "section"), "section").select("section", "markdown")
    empty = sections.limit(1).count() == 0
    head = sections.sparkSession.createDataFrame([(0, REPORT + (f"\n{NOTHING}" if empty else ""))], "section bigint, markdown string")
    out = head.unionByName(sections).repartitionByRange("section").sortWithinPartitions("section")
    out.select(F.col("markdown").alias("value")).write.mode("overwrite").text(path)
