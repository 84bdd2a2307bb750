"""Records as JSON lines, a folder for each target, and the project-wide scan over these folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjudicate import merge_records
from ..operators.citations import expansion_report
from ..operators.ordered import ranked


def write_records(records: DataFrame, path: str, by: str = "target", append: bool = False) -> None:
    """A target's records, by piece and theme: its files, in name order, are sorted. Overwriting replaces the targets that occur, no others."""
    order = [by, *(c for c in ("piece_id", "matched_theme") if c in records.columns)]
    out = records.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(by)
    (out.mode("append") if append else out.option("partitionOverwriteMode", "dynamic").mode("overwrite")).json(path)


def project_records(spark: SparkSession, path: str, schema: str, by: str = "target") -> DataFrame:
    """The records of all targets; of those for one piece and theme that of the last target by name."""
    every = spark.read.schema(f"{schema}, {by} string").json(path)
    return merge_records(every.withColumn("_order", F.col(by)), "_order")


def write_wrapped(records: DataFrame, path: str, order: tuple[str, ...] = ("piece_id", "matched_theme"), **about) -> None:
    """Records as one JSON object, {about..., "record_count": n, "records": [...]}, in text files that are read in name order."""
    n = records.count()
    lead = json.dumps(about | {"record_count": n}, ensure_ascii=False)
    rows = ranked(records, list(order), "_place").select("_place", F.concat(F.to_json(F.struct(*records.columns)), F.when(F.col("_place") < n, ",").otherwise("")).alias("value"))
    edges = records.sparkSession.createDataFrame([(0, lead[:-1] + ', "records": ['), (n + 1, "]}")], "_place bigint, value string")
    rows.unionByName(edges).repartitionByRange("_place").sortWithinPartitions("_place").select("value").write.mode("overwrite").text(path)


def write_expansion(found: DataFrame, path: str, query: str, mode: str, seeds: list[str]) -> None:
    """The works of an expansion (work, ...) in the envelope of `citations.expansion_report`, by work. seeds: those asked for by hand."""
    about = {k: v for k, v in expansion_report(query, mode, seeds, []).items() if k not in ("records", "record_count")}
    write_wrapped(found, path, ("work",), **about)
