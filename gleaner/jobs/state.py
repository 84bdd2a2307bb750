"""A run's small JSON state, in any store that Spark reads: replaced whole, by rename."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: of stored texts: a third less than Spark's default takes, at about its speed
PACKED = {"compression": "zstd"}


@contextmanager
def lean_shuffles(spark: SparkSession):
    """Inside, a finished write drops its shuffle files at once: its result is a table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def no_rows(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty, so that no task runs for it."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)).where("false")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of what lies in a folder; none where there is no folder."""
    p, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _write(fs, path, text: str) -> None:
    out = fs.create(path, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file that must not exist yet; False where it does. One of several writers wins."""
    p, fs = _fs(spark, path)
    q, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.new")
    fs.mkdirs(p.getParent())
    _write(fs, q, text)
    try:
        if fs.getUri().getScheme() == "file":  # a link is made once, a local rename would overwrite
            os.link(q.toUri().getPath(), p.toUri().getPath())
            return True
        return not fs.exists(p) and fs.rename(q, p)  # HDFS refuses to rename onto a file
    except FileExistsError:
        return False
    finally:
        fs.delete(q, False)


def read_json(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """The object in a file; the default where it is missing or broken."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return dict(default or {})
    try:
        found = json.loads(read_text(spark, path))
    except ValueError:
        return dict(default or {})
    return found if isinstance(found, dict) else dict(default or {})


def write_json(spark: SparkSession, path: str, value: dict) -> dict:
    """value with updated_at, written next to the path and moved into place."""
    value = value | {"updated_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    p, fs = _fs(spark, path)
    q, _ = _fs(spark, f"{path}.new")
    _write(fs, q, json.dumps(value, ensure_ascii=False, indent=2) + "\n")
    # one step: the path holds the old state or the new one, never none
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(q, p, how)
    return value


def update_json(spark: SparkSession, path: str, **changes) -> dict:
    return write_json(spark, path, read_json(spark, path) | changes)
