"""Sharding by weighted rendezvous hashing of a record's key.

For each shard the key gets the score -ln(u) / weight, with u in (0, 1) from 52 bits of md5(key:shard);
the shard with the lowest score takes the record. Key and shards alone decide, so one more shard takes
records into itself and moves no other.

Slots number a shard's records from 0 without gaps. A shard may be far too large for one sort, so its
records fall into `buckets` by another hash of the key: rows are numbered within (shard, bucket) and shifted
by the counts of the shard's earlier buckets, a table of shards x buckets rows at most.

Defined cases: a null key hashes as the empty string; rows of equal key land together and their slots follow
text checksum and size; a null text has no bytes and checksum 0; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import save

MAX_BROADCAST_ROWS = 1_000_000


def unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a text's md5."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The index of the winning shard; a weight of 0 takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((-F.log(unit(F.concat(name, F.lit(f":{i}")))) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def shard(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, buckets: int = 256) -> DataFrame:
    """df with size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = df.select(
        *[c for c in df.columns if c not in {text, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "_bucket"}],
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint"), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    out = save(out, "sharded")
    if len(weights) * buckets > MAX_BROADCAST_ROWS:
        raise ValueError("shards x buckets is too large to broadcast")
    counts = out.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_bucket", before.alias("_start"))
    row = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(key, "text_crc32", "size"))
    return out.withColumn("_row", row).join(F.broadcast(starts), ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_start", "_row", "_bucket")
