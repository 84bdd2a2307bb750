"""Merkle manifest of a dataset as a postorder append log.

A tree's leaves stand in order; while more than one node is left, every two neighbours (a last one alone) become the hash
of their digests. Documents make a tree for each language, the trees' roots, by language, one more.

Builders are aligned: each gets the 2^height leaves from a multiple of 2^height on, builds their whole subtree and writes its
nodes in the order in which they are completed. In that order a node's place has a closed form. The node of level l
that begins at leaf s = i * 2^l stands after the 2s - popcount(s) nodes that were completed before leaf s, at the end
of its own subtree, whose size follows from the number of leaves. So a builder's segment, one row with 32 bytes a node, is
contiguous in the log of its tree, and a proof's siblings are read by their places, without any stored index. Roots of segments are
the leaves of the next builders, until one node is left; these upper nodes are rows (tree, place, digest).

A proof lists, level by level, the sibling (none where a node is alone). Lower siblings come from the document's segment,
upper ones by joins of segments with the upper log, once for each segment.

Defined cases: every value is written as its UTF-8 byte count, ":" and itself, null as "-". Leaves of a language go by
doc_id, null first, then by their digest, so repeated rows have the same digests in any order. A null language is a language
and comes first. A single leaf is its tree's root. An empty table has no rows. Other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, save

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(**values: Column) -> Column:
    """The digest of a row's values, in the order of FIELDS."""
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in (values[k] for k in FIELDS)]
    return F.sha2(F.concat(*said), 256)


def height_of(n: int) -> int:
    return (n - 1).bit_length()


def nodes_at(n: int, level: int) -> int:
    return -(-n >> level)


def place(n: int, level: int, i: int) -> int:
    """Where the i-th node of a level stands in the postorder of a tree of n leaves."""
    s = i << level
    if s + (1 << level) <= n:  # a full subtree
        return 2 * s - s.bit_count() + (2 << level) - 2
    size = sum(min(nodes_at(n, l), (i + 1) << (level - l)) - (i << (level - l)) for l in range(level + 1))
    return 2 * s - s.bit_count() + size - 1


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree string, ...) with idx, from 0 in their tree by `order`, and n, the tree's number of leaves. No null trees."""
    kept = leaves.columns
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            code = b.column("tree").dictionary_encode()
            where, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            starts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
            at = np.empty(len(where), np.int64)
            for i, j in zip(starts, starts[1:]):
                if i == j:
                    continue
                k = k if names[where[i]] == last else 0
                at[i:j] = np.arange(k, k + j - i)
                last, k = names[where[i]], k + j - i
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(where), part, np.int32)), pa.array(at)], [*b.schema.names, "_part", "_k"])

    found = save(ranged.mapInArrow(count, ", ".join(f"{c} {t}" for c, t in leaves.dtypes) + ", _part int, _k long"), "numbered")
    counts = found.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range and tree
    per = counts.groupBy("tree").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("_c"))
    before = F.aggregate(F.slice("_c", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda a, c: a + c["_n"])
    per = per.select("tree", "n", "_c", F.posexplode("_c").alias("_i", "_r")).select("tree", "n", F.col("_r._part").alias("_part"), before.alias("_before"))
    return found.join(maybe_broadcast(save(per, "offsets"), 100_000), ["tree", "_part"]).select(*kept, (F.col("_before") + F.col("_k")).alias("idx"), "n")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (tree, block) of a sorted stream."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and (r["tree"], r["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def grow(leaves: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log of trees of leaves (tree, idx, n, digest).

    (tree, block, n, first, nodes): the lowest builders' segments; (tree, place, digest): nodes above; (tree, root).
    """

    def built(level: int):
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _runs(batches):
                n, block = rows[0]["n"], rows[0]["block"]
                log: list[tuple[int, str]] = []
                now, i, top = [r["digest"] for r in rows], rows[0]["idx"], height_of(n)
                for l in range(level, min(level + height, top) + 1):
                    if l > level:
                        now = [digest(*now[k : k + 2]) for k in range(0, len(now), 2)]
                        i >>= 1
                    log += [(place(n, l, i + k), d) for k, d in enumerate(now) if l > level or level == 0]
                log.sort()  # the order of completion
                cols = [[rows[0]["tree"]], [block], [n], [[p for p, _ in log]], [b"".join(bytes.fromhex(d) for _, d in log)], now]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tree", "block", "n", "places", "nodes", "digest"])

        return build

    level, segments, upper = 0, None, []
    while True:
        blocks = leaves.withColumn("block", F.shiftright("idx", height)).select("tree", "block", "idx", "n", "digest")
        blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        made = save(blocks.mapInArrow(built(level), "tree string, block long, n long, places array<long>, nodes binary, digest string"), f"merkle{level}")
        if segments is None:
            segments = made.select("tree", "block", "n", F.get("places", F.lit(0)).alias("first"), "nodes")
            upper.append(made.where(F.col("n") > (1 << height)).select("tree", F.element_at("places", -1).alias("place"), "digest"))
        else:
            part = F.transform("places", lambda p, i: F.struct(p.alias("place"), F.lower(F.hex(F.substring(F.col("nodes"), i * 32 + 1, F.lit(32)))).alias("digest")))
            upper.append(made.select("tree", F.inline(part)))
        level += height
        if not made.where("block > 0").limit(1).count():
            break
        leaves = made.select("tree", F.col("block").alias("idx"), "n", "digest")
    above = upper[0]
    for more in upper[1:]:
        above = above.unionByName(more)
    return segments, above, made.where("block = 0").select("tree", "n", F.col("digest").alias("root"))


def _above(segments: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(tree, block, above array<struct<level, digest>>): the siblings above each segment that has any."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for tree, block, n in zip(b.column("tree").to_pylist(), b.column("block").to_pylist(), b.column("n").to_pylist()):
                for level in range(height, height_of(n)):
                    i = (block >> (level - height)) ^ 1
                    if i < nodes_at(n, level):
                        out.append((tree, place(n, level, i), block, level))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32()))] if out else []
            if cols:
                yield pa.RecordBatch.from_arrays(cols, ["tree", "place", "block", "level"])

    asked = segments.where(F.col("n") > (1 << height)).select("tree", "block", "n").mapInArrow(ask, "tree string, place long, block long, level int")
    return asked.join(above, ["tree", "place"]).groupBy("tree", "block").agg(F.collect_list(F.struct("level", "digest")).alias("above"))


def proofs(leaves: DataFrame, segments: DataFrame, above: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """What `finish(leaf row, siblings, segment row)` makes of each leaf (tree, idx, n, ...); siblings: level by level, None where alone.

    Further columns of segments stay with them.
    """
    full = segments.join(_above(segments, above, height), ["tree", "block"], "left").withColumn("idx", F.lit(-1).cast("long"))
    mine = leaves.withColumn("block", F.shiftright("idx", height))
    both = mine.unionByName(full, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            head, out = rows[0], []
            n, first, nodes = head["n"], head["first"], head["nodes"]
            up = {x["level"]: x["digest"] for x in head["above"] or ()}
            for r in rows[1:]:
                siblings = []
                for level in range(height_of(n)):
                    i = (r["idx"] >> level) ^ 1
                    if level >= height:
                        siblings.append(up.get(level))
                    elif i < nodes_at(n, level):
                        at = 32 * (place(n, level, i) - first)
                        siblings.append(nodes[at : at + 32].hex())
                    else:
                        siblings.append(None)
                out.append(finish(r, siblings, head))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return both.mapInArrow(read, schema)


def fold(node: str, idx: int, siblings: list[str | None]) -> str:
    """The root that a node at place idx and its siblings make."""
    for level, other in enumerate(siblings):
        if other is None:
            node = digest(node)
        else:
            node = digest(other, node) if idx >> level & 1 else digest(node, other)
    return node


def manifest(docs: DataFrame, altered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for rows of FIELDS.

    altered: rows whose n_chars is read one higher when their proof is checked; their root then differs from the manifest's.
    """
    values = {k: F.col(k) for k in FIELDS}
    changed = F.when(F.coalesce(altered if altered is not None else F.lit(False), F.lit(False)), leaf_digest(**values | {"n_chars": F.col("n_chars") + 1}))
    # no tree is null, and the one without a language comes first
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(**values).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("_row"))
    rows = save(rows, "leaves")
    leaves = save(numbered(rows, ["doc_id", "digest", "_row"]).drop("_row"), "ordered")
    discard(rows)
    segments, above, tops = grow(leaves.select("tree", "idx", "n", "digest"), height)

    roots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    roots = save(numbered(roots, ["name"]), "roots")
    root_segments, root_above, root = grow(roots.select("tree", "idx", "n", "digest"), height)
    value = root.select(F.col("root")).first()
    if value is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def over(r: dict, siblings: list[str | None], head: dict) -> dict:
        return {"tree": r["name"], "subroot": r["digest"], "place": r["idx"], "over": siblings}

    paths = save(proofs(roots, root_segments, root_above, height, over, "tree string, subroot string, place long, over array<string>"), "paths")
    segments = segments.join(maybe_broadcast(paths, 100_000), "tree").withColumn("root", F.lit(value[0]))

    def finish(r: dict, siblings: list[str | None], head: dict) -> dict:
        found = fold(fold(r["changed"] or r["digest"], r["idx"], siblings), head["place"], head["over"])
        proof = digest(*(x for x in [*siblings, *head["over"]] if x))
        return {"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": head["subroot"], "root": head["root"], "proof_sha256": proof, "folded_root": found, "verified": found == head["root"]}

    return proofs(leaves, segments, above, height, finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
