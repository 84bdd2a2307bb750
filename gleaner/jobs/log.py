"""The response log: every answer of a screener, appended once it is there and read back once for each key.

Remote answers can't be asked for twice with the same result, so a job first appends them here and only
uses what it reads back. A later run asks only for requests that have no answer under the same fingerprint (pipeline
version and model) to the same prompt: a changed text, theme or prompt is asked anew, all else is not. Requests go out in
slices, each appended when it is done; those to screeners that are `local` (column rules, which cost nothing to ask again)
go out at once. Screeners that are `durable` write each answer to a journal as it comes, so a run or task that is killed
midway loses none: the next run merges what journals hold before it asks.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.dedupe import last_wins
from ..operators.screening import ANSWERED
from ..sources.journal import Journal
from .state import PACKED, delete, exists, lean_shuffles, no_rows

ABOUT = ("model", "provider", "usage")
SCHEMA = "stage string, slot string, fingerprint string, key string, asked string, status string, payload string, error string, attempts int, ord bigint, model string, provider string, usage string"


def fingerprint(**what) -> str:
    """Of what an answer depends on besides its prompt: the model, the pipeline's version."""
    return hashlib.sha256(json.dumps(what, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def with_asked(requests: DataFrame) -> DataFrame:
    """requests with the hash of their prompts, blank where they have none; one that is there already holds."""
    return requests if "asked" in requests.columns else requests.withColumn("asked", F.sha2("prompt", 256) if "prompt" in requests.columns else F.lit(""))


class ResponseLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, stage: str, slot: str, mark: str) -> DataFrame:
        """The last answer for each key and prompt; (key, asked, status, payload, error, attempts, model, provider, usage)."""
        try:
            log = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            log = no_rows(self.spark, SCHEMA)
        own = log.where((F.col("stage") == stage) & (F.col("slot") == slot) & (F.col("fingerprint") == mark) & F.col("status").isin(*ANSWERED))
        return last_wins(own.select("key", "asked", "status", "payload", "error", "attempts", *ABOUT, "ord"), ["key", "asked"], ["ord"]).drop("ord")

    def pending(self, requests: DataFrame, stage: str, slot: str, mark: str) -> DataFrame:
        return with_asked(requests).join(self.read(stage, slot, mark).select("key", "asked"), ["key", "asked"], "left_anti")

    def append(self, answers: DataFrame, stage: str, slot: str, mark: str, ord_: int) -> None:
        about = [F.col(c) if c in answers.columns else F.lit(None).cast("string").alias(c) for c in ABOUT]
        a = answers.select(F.lit(stage).alias("stage"), F.lit(slot).alias("slot"), F.lit(mark).alias("fingerprint"), "key", "asked", "status", "payload", "error", "attempts", F.lit(ord_).cast("bigint").alias("ord"), *about)
        with lean_shuffles(self.spark):
            a.write.mode("append").parquet(self.path, **PACKED)

    def journal(self, stage: str, slot: str, mark: str) -> str:
        return f"{self.path}-journal/{stage}-{slot}-{mark}"

    def merge(self, stage: str, slot: str, mark: str, ord_: int) -> None:
        """Append what journals of killed runs hold, then drop them; repeated, it only repeats rows, of which one counts."""
        folder = self.journal(stage, slot, mark)
        if exists(self.spark, folder):
            # lines that were cut off have no key
            rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(folder)
            self.append(rows.where(F.col("key").isNotNull() & F.col("asked").isNotNull() & F.col("status").isin(*ANSWERED)), stage, slot, mark, ord_)
            delete(self.spark, folder)

    def ask(self, screener, requests: DataFrame, stage: str, slot: str, mark: str, ord_: int = 0, slice_rows: int = 20_000, along: tuple[str, ...] = ()) -> DataFrame:
        """Answers for the requests: what the log lacks is asked and appended, slice by slice, then all is read from the log.

        Each request that has an answer gives one row; along: columns of the requests that go along.
        """
        self.merge(stage, slot, mark, ord_)
        requests = with_asked(requests)
        todo = self.pending(requests, stage, slot, mark)
        n = self.pending(requests.select("key", "asked"), stage, slot, mark).count()
        if n and n == requests.count():
            todo = requests  # no prompt has to be moved to where its answer would be
        slices = min(n, 1) if getattr(screener, "local", False) else -(-n // slice_rows)
        path = f"{self.path}-todo-{slot}-{ord_}"
        if slices > 1:  # a folder for each slice, so that asking one doesn't read the others
            todo.withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(slices))).repartition("_slice").write.mode("overwrite").partitionBy("_slice").parquet(path)
            stored = self.spark.read.schema(StructType([*todo.schema, StructField("_slice", LongType())])).parquet(path)
        folder = self.journal(stage, slot, mark)
        durable = getattr(screener, "durable", False) and Journal.reaches(folder)
        for k in range(slices):
            part = stored.where(F.col("_slice") == k).drop("_slice") if slices > 1 else todo
            answers = screener.screen(part, journal=f"{folder}/{k}") if durable else screener.screen(part)
            answers = answers if "asked" in answers.columns else answers.join(part.select("key", "asked"), "key")
            self.append(answers, stage, slot, mark, ord_)
            if durable:
                delete(self.spark, f"{folder}/{k}")
        if slices > 1:
            delete(self.spark, path)
        return requests.select("key", "asked", *along).join(self.read(stage, slot, mark), ["key", "asked"]).drop("asked")
