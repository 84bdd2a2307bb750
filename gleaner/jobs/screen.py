"""The screening job: documents to final records. All targets go through one plan; a target is a column.

Texts stay in one row for each document until themes single batches out: lines are cut, packed and
judged in place, so nothing is shuffled before the verdicts meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import adjudicate
from ..operators.batches import LIMIT, batch_numbers

# fixed values
THEMES = ((1, "by the"), (2, "ment"), (3, "der"))


def themes_array(themes=THEMES) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(t).alias("theme")) for i, t in themes))


def document_batches(docs: DataFrame, extra: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """(doc_id, extra, batch, pieces array<struct<pos, t, n>>, batch_text, char_count): lines in greedy batches, without a shuffle."""
    cut = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("t"), F.length(F.trim(x)).alias("n")))
    d = docs.select("doc_id", *extra, F.filter(cut, lambda x: x["t"] != "").alias("p"))
    d = d.withColumn("b", batch_numbers(F.transform("p", lambda x: x["n"]), limit))
    # a batch is a slice of the document's lines: its number goes up where the next batch begins
    starts = F.filter(F.transform("b", lambda x, i: F.when((i == 0) | (x != F.get("b", i - 1)), i)), lambda i: i.isNotNull())
    # outer, and filtered afterwards: else Spark infers a filter on s and numbers the batches twice
    d = d.withColumn("s", starts).select("doc_id", *extra, "p", "s", F.posexplode_outer("s").alias("batch", "at")).where("at is not null")
    d = d.withColumn("pieces", F.slice("p", F.col("at") + 1, F.coalesce(F.get("s", F.col("batch") + 1), F.size("p")) - F.col("at")))
    text = F.array_join(F.transform("pieces", lambda x: x["t"]), "\n\n")
    return d.select("doc_id", *extra, "batch", "pieces", text.alias("batch_text"), F.aggregate("pieces", F.lit(0), lambda a, x: a + x["n"]).alias("char_count"))


def coarse_flags(text: Column, chars: Column, theme: Column) -> tuple[Column, Column]:
    """What the two rule screeners say of a batch: one reads any case; the other the case as it stands, in longer batches."""
    return F.lower(text).contains(theme), text.contains(theme) & (chars > 200)


def targeted_flags(text: Column, n: Column, theme: Column) -> tuple[Column, Column]:
    said = F.lower(text).contains(theme)
    return said, (said & (n > 60)) | (n > 300)


def candidates(batches: DataFrame, themes=THEMES) -> DataFrame:
    """One row for each batch and theme that either screener kept."""
    wide = batches.select("*", F.explode(themes_array(themes)).alias("th"))
    a, b = coarse_flags(F.col("batch_text"), F.col("char_count"), F.col("th.theme"))
    return wide.withColumn("llm1", a).withColumn("llm2", b).where("llm1 or llm2").withColumn("theme", F.col("th.theme")).drop("th")


def verdicts(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Both screeners' word on each piece of each candidate: doc_id, piece_id, theme, n, l1, l2, original_text."""
    p = pairs.select("doc_id", *extra, "batch", "theme", F.explode("pieces").alias("p"))
    a, b = targeted_flags(F.col("p.t"), F.col("p.n"), F.col("theme"))
    return p.select("doc_id", *extra, "batch", "theme", F.format_string("%08d-%05d", "doc_id", "p.pos").alias("piece_id"), F.col("p.t").alias("original_text"), F.col("p.n").alias("n"), a.alias("l1"), b.alias("l2"))


def side(v: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    reason = F.when(F.col(flag), F.lit("rule")).otherwise("NA")
    return v.select(*keys, F.col(flag).alias("is_relevant"), reason.alias("reason"), F.lit(False).alias("needs_manual_review"))


def final_records(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, judgment, note, needs_manual_review). Both verdicts of a piece come from one row here, so no join is due."""
    v = verdicts(candidates(document_batches(docs, extra)), extra)
    keys = [*extra, "doc_id", "piece_id", "theme", "original_text", "n"]
    result = lambda flag: F.struct(F.col(flag).alias("is_relevant"), F.when(F.col(flag), "rule").otherwise("NA").alias("reason"), F.lit(False).alias("needs_manual_review"))
    paired = v.where("l1 or l2").select(*keys, result("l1").alias("llm1_result"), result("l2").alias("llm2_result"))
    agreed = F.col("llm1_result.is_relevant") & F.col("llm2_result.is_relevant")
    kept = paired.where(agreed | (F.col("n") % 2 == 0))  # the rule arbiter keeps pieces of even length
    reasons = [F.col("llm1_result.reason"), F.col("llm2_result.reason")]
    note = F.when(agreed, adjudicate.note(*reasons)).otherwise(adjudicate.note(*reasons, F.lit("rule")))
    return kept.select(*keys, F.when(agreed, "consensus").otherwise("arbitrated").alias("judgment"), note.alias("note"), F.lit(False).alias("needs_manual_review"))
