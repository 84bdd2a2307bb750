"""Pages of works as a Spark data source: `spark.read.format("work_pages")`, from a service or from a table of recorded pages.

    spark.dataSource.register(WorkPages)
    spark.read.format("work_pages").option("filters", '["cites:W123"]').option("url", "https://...").load()
    spark.read.format("work_pages").option("filters", ...).option("replay", folder).load()

A partition is up to `pages_per_partition` pages. The service says with each filter's first page how many works
there are; a replay folder holds what `record` wrote, so a read needs no network and gives the same rows each time.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "filter string, page int, pos int, payload string"
PER_PAGE, PAGES = 50, 20
_KINDS = pa.schema([("filter", pa.string()), ("page", pa.int32()), ("pos", pa.int32()), ("payload", pa.string())])


@dataclass(frozen=True)
class Pages(InputPartition):
    """Some (filter, page, file that holds it where pages are recorded)."""

    pages: tuple[tuple[str, int, str], ...]


@dataclass(frozen=True)
class Service:
    """Works by HTTP: GET url?filter=...&per-page=...&page=..., answered by {"meta": {"count": n}, "results": [...]}."""

    url: str
    per_page: int
    params: tuple[tuple[str, str], ...] = ()
    timeout: float = 60.0

    def get(self, ask: str, page: int) -> dict:
        query = urllib.parse.urlencode([("filter", ask), ("per-page", self.per_page), ("page", page), *self.params])
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=self.timeout) as found:
            return json.loads(found.read().decode("utf-8", "replace"))

    def plan(self, asks: list[str]) -> Iterator[tuple[str, int, str]]:
        for ask in asks:
            n = int((self.get(ask, 1).get("meta") or {}).get("count") or 0)
            for page in range(1, -(-n // self.per_page) + 1):
                yield ask, page, ""

    def read(self, part: Pages) -> Iterator[tuple[str, int, list[str]]]:
        for ask, page, _ in part.pages:
            yield ask, page, [json.dumps(w, ensure_ascii=False) for w in self.get(ask, page).get("results") or []]


@dataclass(frozen=True)
class Replay:
    """Recorded pages: Parquet files of (filter, page, payloads). Only names and numbers are read to plan."""

    folder: str

    def _open(self):
        return fs.FileSystem.from_uri(self.folder)

    def plan(self, asks: list[str]) -> Iterator[tuple[str, int, str]]:
        store, root = self._open()
        wanted = pa.array(asks, pa.string())
        found: set[tuple[str, int, str]] = set()
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.is_file and f.path.endswith(".parquet"):
                t = pq.read_table(f.path, filesystem=store, columns=["filter", "page"])
                t = t.filter(pc.is_in(t.column("filter"), wanted))
                found |= {(a, p, f.path) for a, p in zip(t.column("filter").to_pylist(), t.column("page").to_pylist())}
        yield from sorted(found)

    def read(self, part: Pages) -> Iterator[tuple[str, int, list[str]]]:
        store, _ = self._open()
        for path, own in groupby(sorted(part.pages, key=lambda p: p[2]), key=lambda p: p[2]):
            wanted = {(ask, page) for ask, page, _ in own}
            t = pq.read_table(path, filesystem=store, filters=[("filter", "in", sorted({ask for ask, _ in wanted}))])
            for ask, page, works in zip(*(t.column(c).to_pylist() for c in ("filter", "page", "payloads"))):
                if (ask, page) in wanted:
                    yield ask, page, works


class WorkPages(DataSource):
    """Options: filters (a JSON array), url or replay, per_page, pages_per_partition; others go to the service as parameters."""

    OWN = {"filters", "url", "replay", "per_page", "pages_per_partition", "path"}

    @classmethod
    def name(cls) -> str:
        return "work_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = {k.lower(): v for k, v in dict(self.options).items()}
        if ("url" in o) == ("replay" in o):
            raise ValueError("give url or replay")
        asks = list(dict.fromkeys(json.loads(o.get("filters", "[]"))))
        source = Replay(o["replay"]) if "replay" in o else Service(o["url"], int(o.get("per_page", PER_PAGE)), tuple(sorted((k, v) for k, v in o.items() if k not in self.OWN)))
        return Reader(source, asks, int(o.get("pages_per_partition", PAGES)))


class Reader(DataSourceReader):
    def __init__(self, source: Service | Replay, asks: list[str], pages: int):
        self.source, self.asks, self.pages = source, asks, max(1, pages)

    def partitions(self) -> list[Pages]:
        every = list(self.source.plan(self.asks))
        return [Pages(tuple(every[i : i + self.pages])) for i in range(0, max(len(every), 1), self.pages)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for ask, page, works in self.source.read(partition):
            if works:
                n = len(works)
                yield pa.RecordBatch.from_arrays([pa.array([ask] * n), pa.array([page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(works, pa.string())], schema=_KINDS)


def record(works: DataFrame, folder: str, per_page: int = PER_PAGE) -> None:
    """Write works (filter, at, payload; at: a place from 0 in the filter) as pages that a replay reads, sorted by filter."""
    page = (F.floor(F.col("at") / per_page) + 1).cast("int").alias("page")
    pages = works.groupBy("filter", page).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "payload"))), lambda x: x["payload"]).alias("payloads"))
    pages.repartitionByRange("filter", "page").sortWithinPartitions("filter", "page").write.mode("overwrite").parquet(folder)
