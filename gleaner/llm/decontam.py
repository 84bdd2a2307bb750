"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of n distinct five-word shingles is contained in a document if at least `threshold` of them
occur there. Items are partitioned by size, [2^c, 2^(c+1)). Each partition has one signature length: with
u = 2^(c+1) - 1 shingles at most, u - ceil(threshold * u) + 1. An item's signature is that many of its shingles
that come first in one order of all shingles (its bottom-k MinHash): by the number of items that have them, then by hash. A document that contains the item misses too few shingles
to miss the whole signature, so looking the documents' shingles up among the signatures loses no pair. Pairs that
are found so are verified by counting the item's shingles, as strings, in the document. The document's own
size never lowers the score, so short items in long documents are found.

Words are maximal runs of letters and digits of the lower-cased text. Texts of one to four words have one
shingle, all words; null, empty and wordless texts have none and match nothing. Repeated rows of one doc_id
count as one document, of one item_id as one item with the shingles of all; rows without doc_id or item_id are passed over. Signatures (and candidates) are
broadcast only after their count is known to be under `max_broadcast`; else the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import maybe_broadcast, save


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(n: int) -> Column:
    """Positions of the shingles of the array column w."""
    return F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).when(F.size("w") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def shingle_strings(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, s): the distinct shingles of each text, as strings."""
    w = df.where(F.col(key).isNotNull()).select(key, words(F.col("text")).alias("w"))
    return w.select(key, F.explode(F.transform(_starts(n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).alias("s")).distinct()


def shingle_hashes(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, h): a 64-bit hash for each shingle, repeats included."""
    w = df.where(F.col(key).isNotNull()).select(key, words(F.col("text")).alias("w"))
    return w.select(key, F.explode(F.transform(_starts(n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)]))).alias("h"))


def signatures(items: DataFrame, n: int = 5, threshold: float = 0.8, max_broadcast: int = 1_000_000) -> DataFrame:
    """(item_id, n_shingles, need, size_class, h): each item's bottom-k shingles, k by its size partition.

    Smallest are those of the fewest items, then of the smallest hash: one order for all items, so what a prompt's
    fixed words have in common is looked up only for items that have little else.
    """
    h = shingle_hashes(items, "item_id", n).distinct()
    shared = h.groupBy("h").agg(F.count(F.lit(1)).alias("in_items")).where("in_items > 1")
    one = W.partitionBy("item_id")
    s = h.join(maybe_broadcast(shared, max_broadcast), "h", "left").withColumn("n_shingles", F.count(F.lit(1)).over(one))
    s = s.withColumn("at", F.row_number().over(one.orderBy(F.coalesce("in_items", F.lit(1)), "h")))
    s = s.withColumn("size_class", F.floor(F.log2(F.col("n_shingles").cast("double"))).cast("int"))
    most = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    length = most - F.ceil(most * threshold - 1e-9) + 1
    need = F.ceil(F.col("n_shingles") * threshold - 1e-9).cast("int").alias("need")
    return s.where(F.col("at") <= length).select("item_id", "n_shingles", need, "size_class", "h")


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of the items that documents contain."""
    sig = save(signatures(items, n, threshold, max_broadcast), "signatures")
    found = shingle_hashes(docs, "doc_id", n).join(maybe_broadcast(sig.select("item_id", "h"), max_broadcast), "h")
    pairs = save(found.select("doc_id", "item_id").distinct(), "candidates")
    ids, chosen = pairs.select("doc_id").distinct(), pairs.select("item_id").distinct()
    in_docs = shingle_strings(docs.join(maybe_broadcast(ids, max_broadcast), "doc_id", "left_semi").select("doc_id", "text"), "doc_id", n)
    in_items = shingle_strings(items.join(chosen, "item_id", "left_semi").select("item_id", "text"), "item_id", n)
    in_items = in_items.withColumn("n_shingles", F.count(F.lit(1)).over(W.partitionBy("item_id")))
    wanted = pairs.join(maybe_broadcast(in_items, max_broadcast), "item_id")
    hit = wanted.join(in_docs, ["doc_id", "s"]).groupBy("doc_id", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_found"))
    hit = hit.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return hit.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9)).select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def clean_documents(docs: DataFrame, items: DataFrame, max_broadcast: int = 1_000_000, **how) -> DataFrame:
    """docs without those that contain a test item."""
    bad = save(contained_items(docs, items, max_broadcast=max_broadcast, **how).select("doc_id").distinct(), "contaminated")
    return docs.join(maybe_broadcast(bad, max_broadcast), "doc_id", "left_anti")
