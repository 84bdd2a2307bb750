"""Line dedup by overlapping three-line windows.

Lines are the pieces of a text between line feeds. Every run of `window` consecutive lines is hashed
(96 bits); of each window that occurs more than once over all documents the first occurrence, by doc_id
and line number, stays, and the lines that later occurrences cover are removed. Runs of covered lines are
merged before the text is put together anew.

Defined cases: a null text gives no lines and stays null; a text of fewer lines than a window is left as
it is; windows whose lines are all blank never count; rows are told apart by a saved row number, so rows that share a
doc_id (null included) are documents of their own: doc_id, null first, and then the row number only say which occurrence is
the first; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, save


def windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """(row, doc_id, pos, h1, h2): one row per run of consecutive lines that isn't blank throughout. docs: row, doc_id, text."""
    lines = docs.where(F.length("text") >= window).select("row", "doc_id", F.split("text", "\n").alias("lines")).where(F.size("lines") >= window)

    def key(i):
        run = [F.get("lines", i + k) for k in range(window)]
        return F.struct(F.xxhash64(*run).alias("h1"), F.hash(*run).alias("h2"), (F.length(F.trim(F.concat(*run))) > 0).alias("said"))

    keys = F.transform(F.sequence(F.lit(0), F.size("lines") - window), key)
    return lines.select("row", "doc_id", F.posexplode(keys).alias("pos", "k")).where("k.said").select("row", "doc_id", "pos", "k.h1", "k.h2")


def covered_runs(docs: DataFrame, window: int = 3) -> DataFrame:
    """(row, runs array<struct<s,e>>): the merged runs of lines, both ends included, that go. docs: row (unique), doc_id, text."""
    w = save(windows(docs, window), "windows")
    seen = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "pos")).alias("first")).where("n > 1")
    seen = seen.select("h1", "h2", F.col("first.row").alias("r0"), F.col("first.pos").alias("p0"))
    later = w.join(seen, ["h1", "h2"]).where((F.col("row") != F.col("r0")) | (F.col("pos") != F.col("p0"))).select("row", "pos").repartition("row")
    by_row = W.partitionBy("row").orderBy("pos")
    apart = F.coalesce((F.col("pos") - F.lag("pos").over(by_row) > window).cast("int"), F.lit(1))
    runs = later.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_row))
    runs = runs.groupBy("row", "run").agg(F.min("pos").alias("s"), (F.max("pos") + window - 1).alias("e"))
    runs = save(runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs")), "runs")
    discard(w)
    return runs


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """docs with the covered lines taken out of `text`, and columns n_lines, n_removed (longs), dedup_runs."""
    rows = save(docs.drop("n_lines", "n_removed", "dedup_runs").withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = covered_runs(rows.select(F.col("__row").alias("row"), "doc_id", "text"), window)
    out = rows.join(found.select(F.col("row").alias("__row"), F.col("runs").alias("__runs")), "__row", "left").drop("__row")
    lines, runs = F.split("text", "\n"), F.coalesce("__runs", F.array().cast("array<struct<s:int,e:int>>"))

    def gap(i):  # what lies between one run and the next
        start = F.coalesce(F.get("__runs", i - 1)["e"], F.lit(-1)) + 1
        return F.slice(lines, start + 1, F.coalesce(F.get("__runs", i)["s"], F.size(lines)) - start)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("__runs")), gap)), "\n")
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"] + 1)
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_removed", removed).withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(kept))
    return out.withColumn("dedup_runs", runs).drop("__runs")
