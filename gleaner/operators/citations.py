"""Citation expansion: one hop from seed works along citing or referenced works, each found work once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def work_id(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def doi(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^https?://(?:dx\.)?doi\.org/", "")


def abstract(index: Column) -> Column:
    """The text of an inverted index, map<word, array<position>>."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")


WORK = (
    "id string, doi string, display_name string, publication_year int, type string, authorships array<struct<author: struct<display_name: string>>>, "
    "primary_location struct<source: struct<display_name: string>, landing_page_url: string>, abstract_inverted_index map<string, array<int>>, cited_by_count int"
)


def normalize_works(works: DataFrame, payload: str = "payload") -> DataFrame:
    """works with source, id, openalex_id, doi, title, year, type, authors, journal, abstract and cited_by_count from their JSON."""
    w = F.from_json(payload, WORK)
    names = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return works.select(
        *(c for c in works.columns if c != payload), F.lit("openalex").alias("source"), w["id"].alias("id"), work_id(w["id"]).alias("openalex_id"),
        F.coalesce(doi(w["doi"]), F.lit("")).alias("doi"), F.coalesce(w["display_name"], F.lit("")).alias("title"), w["publication_year"].alias("year"), w["type"].alias("type"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.coalesce(w["primary_location"]["source"]["display_name"], F.lit("")).alias("journal"),
        F.coalesce(abstract(w["abstract_inverted_index"]), F.lit("")).alias("abstract"), F.coalesce(w["cited_by_count"], F.lit(0)).alias("cited_by_count"),
    )


def fetch_works(asks: DataFrame, fetcher: Callable[[str, int, int], list[str]], per_page: int = 50, partitions: int = 8) -> DataFrame:
    """(filter, page, payload): asks' filters fetched on executors, page after page until one isn't full. fetcher(filter, per_page, page) -> JSON works.

    Services may answer differently a second time: write the result before using it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ask in b.column(0).to_pylist():
                page, got = 1, [""] * per_page
                while len(got) == per_page:
                    got = fetcher(ask, per_page, page)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([ask] * len(got)), pa.array([page] * len(got), pa.int32()), pa.array(got, pa.string())], ["filter", "page", "payload"])
                    page += 1

    return asks.select("filter").repartition(partitions, "filter").mapInArrow(run, "filter string, page int, payload string")


def expand(seeds: DataFrame, edges: DataFrame, round_index: int, via: str) -> DataFrame:
    """(work, parents, n_parents, discovered_round, discovered_via).

    seeds: seed_ord, seed. edges: citing, cited. via "cited_by": works that cite a seed; "referenced_works": works a seed cites.
    A work found from many seeds lists them in seed order; a hub's list is as long as the number of seeds.
    """
    there, here = ("citing", "cited") if via == "cited_by" else ("cited", "citing")
    hit = edges.select(F.col(here).alias("seed"), F.col(there).alias("work")).join(seeds, "seed").select("work", "seed_ord", "seed").distinct()
    parents = F.transform(F.array_sort(F.collect_list(F.struct("seed_ord", "seed"))), lambda x: x["seed"])
    out = hit.groupBy("work").agg(F.array_distinct(parents).alias("parents"))
    return out.withColumn("n_parents", F.size("parents").cast("bigint")).withColumn("discovered_round", F.lit(round_index)).withColumn("discovered_via", F.lit(via))


def expansion_report(query: str, mode: str, seeds: list[str], records: list[dict]) -> dict:
    """The envelope of an expansion that was asked for by hand."""
    return {"provider": "openalex-expand", "expand_mode": mode, "query": query, "params": {"seed_ids": seeds}, "fetches": [{"seed_id": s} for s in seeds], "records": records, "record_count": len(records)}
