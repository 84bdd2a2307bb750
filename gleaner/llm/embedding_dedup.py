"""Embedding near-dedup by cross-polytope hashing.

A table's hash is made of `hashes` parts: the vector is turned by three rounds of random signs and a fast Hadamard
transform, and its part is the index and sign of the largest coordinate. Each vector is filed in its own bucket of
each table and also visits the `probes` buckets that a small turn would have put it in. Pairs that meet in a
bucket of their label are verified by cosine in double precision.

Equal vectors of a label are one class; classes meet, once for each pair: in the first table that brings them
together, which both can tell from their vectors. A bucket above `block` rows is dealt out as pairs of its
blocks, so no task gets it whole. A task returns, for each class, how many vectors it linked to and the first
class of its part of the component; never the pairs.

Defined cases: rows whose label or vector is null, whose vector is empty, all zero or holds null or non-finite
components link with nothing (n_links 0, own component); vectors of different lengths never meet; rows that repeat a
vec_id are vectors of their own, which link with each other like any (a component is named by its smallest vec_id); a null vec_id has a null component. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_labels, save
from .components import connected_components


class CrossPolytope:
    """Buckets of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * hashes, 3, self.size))

    def _turn(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x, h = x * s, 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), -1)
                h *= 2
        return x / np.sqrt(float(self.size)) ** len(signs)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table, 1 + probes) buckets: the vector's own, then those it visits."""
        padded = np.zeros((len(unit), self.size))
        padded[:, : self.dim] = unit
        out = np.zeros((len(unit), self.tables, 1 + self.probes), np.int64)
        every, base = np.arange(len(unit)), 2 * self.size
        for t in range(self.tables):
            vertex, loss = [], []
            for k in range(self.hashes):
                y = self._turn(padded, self.signs[t * self.hashes + k])
                a = np.abs(y)
                top = np.argpartition(-a, min(3, self.size - 1), axis=1)[:, :3]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(a, top, 1), axis=1, kind="stable"), 1)
                vertex.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
                best = np.take_along_axis(a, top, 1)
                loss.append(best[:, :1] - best)
            own = sum(v[:, 0] * base**k for k, v in enumerate(vertex))
            out[:, t, 0] = own
            # one part's second or third choice; or two parts' second choices
            ways = [({k: c}) for k in range(self.hashes) for c in range(1, vertex[0].shape[1])]
            ways += [{i: 1, j: 1} for i, j in combinations(range(self.hashes), 2)]
            cost = np.stack([sum(loss[k][:, c] for k, c in w.items()) for w in ways], 1)
            moved = np.stack([own + sum((vertex[k][:, c] - vertex[k][:, 0]) * base**k for k, c in w.items()) for w in ways], 1)
            for p, at in enumerate(np.argsort(cost, axis=1, kind="stable")[:, : self.probes].T, 1):
                out[:, t, p] = moved[every, at]
        return out


def _unit(rows: pa.Array, dim: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and the bucket in it, where vectors of buckets a[i] and b[i] meet."""
    in_b = (a == b[:, :, :1]).any(2)  # a comes to b's own bucket
    in_a = (b == a[:, :, :1]).any(2)
    first = (in_a | in_b).argmax(1)
    at = np.arange(len(a))
    own_a, own_b = a[at, first, 0], b[at, first, 0]
    both = np.minimum(own_a, own_b)
    return first, np.where(in_a[at, first] & in_b[at, first], both, np.where(in_a[at, first], own_a, own_b))


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    n = np.diff(column.offsets.to_numpy())
    for dim in np.unique(n):
        yield int(dim), np.flatnonzero(n == dim)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, tables: int = 5, hashes: int = 2, probes: int = 3, block: int = 8192, seed: int = 11
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label)."""
    hashers: dict[int, CrossPolytope] = {}

    def hasher(dim: int) -> CrossPolytope:
        if dim not in hashers:
            hashers[dim] = CrossPolytope(dim, tables, hashes, probes, seed)
        return hashers[dim]

    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound, F.lit(False))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(kind))
    v = v.withColumn("sound", sound).withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.hash("embedding", "label"))
    classes = v.where("sound").groupBy("h1", "h2", "label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    # a class is known by its number; vec_ids only name components
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                b = batch.slice(part, 4096)
                for dim, rows in _by_dim(b.column("embedding")):
                    own = b.take(pa.array(rows))
                    at = hasher(dim).buckets(_unit(own.column("embedding"), dim)).reshape(len(rows), -1)
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel()))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(rows), dim, np.int32)), codes], [*own.schema.names, "dim", "codes"])

    key = ["label", "dim", "tab", "bucket"]
    # every vector is hashed once, for all tables; its codes go where it goes
    coded = classes.select("label", "embedding", "rep", "n").mapInArrow(code, f"label string, embedding {kind}, rep long, n long, dim int, codes array<long>")
    coded = save(coded, "codes")

    def filed(*more: str) -> DataFrame:
        out = coded.select("label", "dim", F.posexplode("codes").alias("_at", "bucket"), *more)
        return out.select("label", "dim", F.expr(f"cast(_at div {1 + probes} as int)").alias("tab"), "bucket", (F.col("_at") % (1 + probes) == 0).alias("filed"), *more)

    # buckets in which nothing can meet are left out before any vector moves
    sizes = filed().groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("filed").alias("own")).where("rows > 1 and own")
    sizes = save(sizes.select(*key, F.when(F.col("rows") > block, F.ceil(F.col("rows") / (block // 2))).otherwise(1).cast("int").alias("blocks")), "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:  # rows come sorted by group
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for i, j in zip(cut, cut[1:]):
                if held and g[i] != last:
                    yield from judge(held)
                    held = []
                held.append(b.slice(i, j - i))
                last = g[i]
        if held:
            yield from judge(held)

    def judge(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        if t.num_rows < 2:
            return
        dim, table, bucket, bi, bj = (t.column(c)[0].as_py() for c in ("dim", "tab", "bucket", "bi", "bj"))
        rep, n, filed, own = (t.column(c).to_numpy() for c in ("rep", "n", "filed", "own"))
        codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(rep), tables, 1 + probes)
        x = _unit(t.column("embedding").combine_chunks(), dim)
        left, right = (np.flatnonzero(own == bi), np.flatnonzero(own == bj))
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for part in np.array_split(left, len(left) // 512 + 1):
            near = x[part] @ x[right].T >= threshold
            near &= filed[part][:, None] | filed[right][None, :]
            if bi == bj:
                near &= part[:, None] < right[None, :]
            a, b = np.nonzero(near)
            for some in np.array_split(np.arange(len(a)), len(a) // 50_000 + 1) if len(a) else []:
                i, j = part[a[some]], right[b[some]]
                first, where = _met(codes[i], codes[j])
                here = (first == table) & (where == bucket) & (rep[i] != rep[j])
                i, j = i[here], j[here]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                label = merge_labels(label, i, j)
        low = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(low, label, rep)
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(low[label[hit]])], ["rep", "links", "root"])

    visits = filed("rep").join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("bi"), F.greatest(k, F.col("own")).alias("bj")))
    visits = visits.withColumn("pair", F.explode(others)).select(F.xxhash64(*key, "pair").alias("g"), "tab", "bucket", "pair.bi", "pair.bj", "own", "filed", "rep")
    dealt = save(visits, "visits").join(coded.select("rep", "dim", "n", "embedding", "codes"), "rep")
    found = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "rep long, links long, root long")
    found = save(found, "found")
    comps = connected_components(found, "rep", "root").withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "rep", "low", "n").join(links, "rep", "left").join(comps, "rep", "left").withColumn("c", F.coalesce("component_id", "rep"))
    lows = known.groupBy("c").agg(F.min("low").alias("comp"))
    known = known.join(lows, "c").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "comp", F.lit(True).alias("sound"))
    out = v.select("vec_id", "sound", "h1", "h2").join(known, ["h1", "h2", "sound"], "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
