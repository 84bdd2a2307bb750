"""Helpers that the training-data operators share: shared tables, lean shuffles, small label merging."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none (a local test), a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def lean_shuffles(spark: SparkSession):
    """Inside, a finished action drops its shuffle files at once: its result is a table by then."""
    before = spark.conf.get(_LEAN, None)
    spark.conf.set(_LEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_LEAN) if before is None else spark.conf.set(_LEAN, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs no redo."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with lean_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(saved: DataFrame) -> None:
    """Delete a table that `save` made and nothing reads any more."""
    path = saved.sparkSession._jvm.org.apache.hadoop.fs.Path(saved._saved_at)
    path.getFileSystem(saved.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """A stream sorted by a whole-number column in tables of whole groups, each as soon as it has at_least rows: what a task
    holds follows from its largest group, not from its partition."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            k = b.column(key).to_numpy()
            if n >= at_least:
                # up to where the last held group ends
                same = k == held[-1].column(key)[-1].as_py()
                cut = len(k) if same.all() else int(np.argmin(same))
                if cut:
                    held.append(b.slice(0, cut))
                    b = b.slice(cut)
                if b.num_rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                continue
            take = min(len(k), at_least - n)
            held.append(b.slice(0, take))
            n, b = n + take, b.slice(take)
    if held:
        yield pa.Table.from_batches(held)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union positions a[i] and b[i]; label holds each position's smallest reachable position."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt
