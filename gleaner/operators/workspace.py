"""The files that each stage of a project must have."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
REQUIRED = (
    (1, "1_journal_targeting.md"), (1, "1_research_proposal.md"),
    (2, "2_primary_corpus.yaml"),
    (3, "3a_deepened_thinking.md"), (3, "3c_scholarship_map.md"), (3, "_stage3b/candidate_papers.md"), (3, "_stage3b/papers/"),
    (4, "4_outline_matrix.yaml"), (4, "4_argument_audit.md"),
    (5, "5_first_draft.md"),
    (6, "6_final_manuscript.md"), (6, "6_abstract_keywords.md"), (6, "6_title_options.md"), (6, "6_anonymous_submission_checklist.md"), (6, "6_claim_boundary.md"),
)


def stage_status(required: DataFrame, present: DataFrame) -> DataFrame:
    """(project, stage, status, n_missing): required (stage, path) against present (project, path), for each project."""
    projects = present.select("project").distinct()
    every = projects.crossJoin(F.broadcast(required))  # required is a fixed list
    # any file in a folder stands for the folder
    folder = F.when(F.col("path").rlike("^_stage3b/papers/.+"), "_stage3b/papers/").otherwise(F.col("path"))
    p = present.select("project", folder.alias("path")).distinct().withColumn("there", F.lit(1))
    j = every.join(p, ["project", "path"], "left").groupBy("project", "stage").agg(F.count("there").alias("found"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("found") == F.col("n"), "complete").when(F.col("found") > 0, "partial").otherwise("missing")
    return j.select("project", "stage", status.alias("status"), (F.col("n") - F.col("found")).alias("n_missing"))


def next_stage(status: DataFrame, last: int = 6) -> DataFrame:
    """(project, highest_completed_stage, next_stage): the stage before the first that isn't complete, and that one."""
    open_ = F.min(F.when(F.col("status") != "complete", F.col("stage")))
    out = status.groupBy("project").agg(open_.alias("o"), F.max("stage").alias("top"))
    nxt = F.coalesce("o", F.when(F.col("top") < last, F.col("top") + 1))
    return out.select("project", (F.coalesce(F.col("o"), F.col("top") + 1) - 1).alias("highest_completed_stage"), nxt.alias("next_stage"))


def project_names(spark: SparkSession, root: str) -> list[str]:
    """The folders below a root, sorted; hidden ones are no projects."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(path) if store.exists(path) else []
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith("."))


def present_files(spark: SparkSession, root: str, partitions: int = 8) -> DataFrame:
    """(project, path): the files of all projects, as `stage_status` takes them, listed by tasks, in stores that Arrow reaches.

    Spark's own listing passes over folders whose names begin with "_".
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for project in b.column(0).to_pylist():
                top = f"{base.rstrip('/')}/{project}"
                paths = [f.path[len(top) + 1 :] for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file]
                yield pa.RecordBatch.from_arrays([pa.array([project] * len(paths), pa.string()), pa.array(paths, pa.string())], ["project", "path"])

    names = spark.createDataFrame([(p,) for p in project_names(spark, root)], "project string")
    return names.repartition(partitions).mapInArrow(listed, "project string, path string")
