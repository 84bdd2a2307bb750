"""Connected components of links by alternating large-star and small-star rounds.

Links stay distributed. Each round is an aggregation and a join on the node: the aggregation combines
before it shuffles and the join may be split by adaptive execution, so a hub with a third of all links
is no single task's work. Rounds end when the set of links no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    joined = large.join(_smallest(large), "u")
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return small.where("u > v").distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component_id) for every id that is not the smallest of its component.

    links: pairs of longs in columns a and b, either order, repeats allowed. Nulls and loops are no links.
    Ids that are missing from the result are their own component.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    sign = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v")))
    before = links.agg(sign).first()[0]
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        links = save(_round(links), "links")
        after = links.agg(sign).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
