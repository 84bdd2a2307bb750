"""Near copies by the exact similarity of their five-word shingles, for the pipeline's stage.

Two documents are linked if their sets of shingles (words as in `simhash`) have a Jaccard similarity of `threshold` or
more; groups are the components of these links.

1. Documents with equal sets are one from here on.
2. Candidates come from the trie self-join of `simhash` over fingerprints of the same shingles, and from bands of
   minima: on sf0.1 pairs of similarity 0.8 to 0.9 differ in more than 12 of 64 bits at times, and 13 or more blocks of
   64 bits are too short to keep groups small. A band is the hash of `rows` minima; a pair at the threshold has none of `bands` bands in
   common with a probability of (1 - threshold ** rows) ** bands, 5e-6 by default.
3. In each band a document is paired with the first one, so a large group makes no more pairs than it has rows. Pairs are
   confirmed exactly, by their sets of 64-bit shingle hashes; components are made of confirmed links alone, so texts that only share
   some boilerplate don't chain.
4. A band whose documents are still in several components (and more than two, as the first is paired with each) is
   gone through as a whole: a document's rarest shingles, as many as one of them must occur in each similar set (prefix
   filter), name those to compare; pairs that links already join are skipped. Bands with the same documents count once. A
   band of more than `block` documents goes as pairs of blocks, to a task each.

Defined cases: null, empty and wordless texts have the empty set and are copies of each other. Rows are told apart by a
saved row number: a null doc_id is a document like others, as are rows that repeat a doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, save, whole_groups
from .components import connected_components
from .simhash import fingerprint_links, majority, shingle_hashes
from .tokens import pieces_of

AT_ONCE = 1 << 12  # shingles whose minima are taken at once
ROWS_AT_ONCE = 1 << 18  # rows of whole bands that a task joins at once


def _band_hashes(hashes: np.ndarray, odd: np.ndarray, bands: int) -> list[int]:
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), AT_ONCE):
        np.minimum(low, (hashes[None, i : i + AT_ONCE] * odd[:, None]).min(1), out=low)
    body, step, digest = low.tobytes(), 8 * len(odd) // bands, xxhash.xxh3_64_intdigest
    return [digest(body[i * step : (i + 1) * step], i) - (1 << 63) for i in range(bands)]


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(row, fp, k1, k2, bands): the fingerprint, a 128-bit hash of the set, the bands. docs: row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(7).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for b in pieces_of(batch, 1):
                fp, keys, found = [], [], []
                for t in b.column(1):
                    every = shingle_hashes(t.as_py(), shingle)
                    some = np.unique(every)
                    fp.append(majority(every))
                    keys.append(xxhash.xxh3_128_digest(some.tobytes()))
                    found.append(_band_hashes(some, odd, bands) if len(some) else [])
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                cols = [b.column(0), pa.array(fp, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "fp", "k1", "k2", "bands"])

    return docs.mapInArrow(run, "row long, fp long, k1 long, k2 long, bands array<long>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, row) -> (band, a, b): each row and the first one with its band."""
    for t in whole_groups(batches, "band", ROWS_AT_ONCE):
        band, row = t.column(0).to_numpy(), t.column(1).to_numpy()
        order = np.lexsort((row, band))
        band, row = band[order], row[order]
        new = np.append(True, band[1:] != band[:-1])
        first = row[np.flatnonzero(new)][np.cumsum(new) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(x[~new]) for x in (band, row, first)], ["band", "a", "b"])


def _sets(shingle: int):
    """(row, text) -> (row, items): the distinct shingles' hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_of(batch, 1):
                items = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.int64()))], ["row", "items"])

    return run


def similar_pairs(sets: list[np.ndarray], threshold: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of linked sets: a spanning forest of all links, beyond what is known. sets: distinct values each; known: each
    set's component so far."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token = rank[token]
    ends = np.cumsum(sizes)
    ranked = [np.sort(token[e - n : e]) for e, n in zip(ends, sizes)]
    need = np.ceil(sizes * threshold - 1e-9).astype(np.int64)
    by_size = np.argsort(sizes, kind="stable")
    prefix = [ranked[i][: sizes[i] - need[i] + 1] for i in by_size]
    where = np.repeat(np.arange(m), [len(p) for p in prefix])
    keys = np.concatenate(prefix)
    order = np.argsort(keys, kind="stable")
    keys, where = keys[order], where[order]  # each shingle's documents, by size
    label, mark, out = np.arange(m), np.zeros(len(df), bool), []
    if known is not None:
        _, at, which = np.unique(known[by_size], return_index=True, return_inverse=True)
        label = at[which]
    for at, i in enumerate(by_size.tolist()):
        p = prefix[at]
        lo, hi = np.searchsorted(keys, p), np.searchsorted(keys, p, "right")
        near = [where[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b - a > 1]
        if not near:
            continue
        near = np.concatenate(near)
        near, shared = np.unique(near[near < at], return_counts=True)
        near = near[np.argsort(-shared, kind="stable")]
        near = near[sizes[by_size[near]] >= need[i]]
        mark[ranked[i]] = True
        while len(near := near[label[near] != label[at]]):
            # one by one until a link, which may join many
            for k, j in enumerate(near.tolist()):
                other = int(by_size[j])
                common = int(np.count_nonzero(mark[ranked[other]]))
                if common >= threshold * (sizes[i] + sizes[other] - common) - 1e-9:
                    out.append((i, other))
                    label[label == label[j]] = label[at]
                    break
            near = near[k + 1 :]
        mark[ranked[i]] = False
    return out


def _compare(threshold: float):
    """(key, row, comp, items), sorted by key -> (a, b): links between components of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 1):
            rows, comp = t.column("row").to_numpy(), t.column("comp").to_numpy()
            key = t.column("key").to_numpy()
            items = t.column("items").combine_chunks()
            flat, ends = items.values.to_numpy(), items.offsets.to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for i, j in zip(cut, cut[1:]):
                pairs = similar_pairs([flat[ends[k] : ends[k + 1]] for k in range(i, j)], threshold, comp[i:j])
                if pairs:
                    a, b = np.array(pairs).T + i
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(rows[b])], ["a", "b"])

    return run


def links(docs: DataFrame, each: DataFrame, shingle: int = 5, threshold: float = 0.8, block: int = 4000) -> DataFrame:
    """(a, b): links between rows that span all links. docs: row, text; each: row, fp, bands of distinct sets."""
    bands = each.select(F.explode("bands").alias("band"), "row").repartition("band").sortWithinPartitions("band")
    shared = save(bands.mapInArrow(_stars, "band long, a long, b long"), "shared")
    fps = save(each.where(F.size("bands") > 0).groupBy("fp").agg(F.min("row").alias("rep")), "fingerprints")
    same = each.where(F.size("bands") > 0).join(fps, "fp").where("row <> rep").select(F.col("row").alias("a"), F.col("rep").alias("b"))
    near = shared.select("a", "b").unionByName(same).unionByName(fingerprint_links(fps))
    near = save(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    wanted = save(near.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "wanted")
    sets = docs.join(maybe_broadcast(wanted, 1_000_000), "row", "left_semi").select("row", F.col("text").cast("string").alias("text"))
    sets = save(sets.mapInArrow(_sets(shingle), "row long, items array<long>"), "items")
    side = lambda c: sets.select(F.col("row").alias(c), F.col("items").alias(f"{c}s"))
    common = F.size(F.array_intersect("as", "bs"))
    similar = common >= threshold * (F.size("as") + F.size("bs") - common) - 1e-9
    confirmed = save(near.join(side("a"), "a").join(side("b"), "b").where(similar).select("a", "b"), "confirmed")
    discard(near)

    comps = connected_components(confirmed, "a", "b")
    members = shared.select("band", F.col("a").alias("row")).unionByName(shared.select("band", F.col("b").alias("row")).distinct())
    members = members.join(comps.withColumnRenamed("id", "row"), "row", "left").select("band", "row", F.coalesce("component_id", "row").alias("comp"))
    members = save(members, "members")
    who = (F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    mixed = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), *who).where("n > 2 and low <> high")
    mixed = mixed.groupBy("n", "x", "y").agg(F.min("band").alias("band"))
    mixed = save(mixed.select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "mixed")
    mine = members.join(maybe_broadcast(mixed, 1_000_000), "band")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    mine = mine.withColumn("own", own).withColumn("j", F.explode(others))
    key = F.struct("band", F.least("own", "j").alias("p"), F.greatest("own", "j").alias("q"))
    mine = save(mine.select(F.xxhash64(key).alias("key"), "row", "comp"), "meetings")
    found = mine.join(sets, "row").select("key", "row", "comp", "items").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(threshold), "a long, b long")
    return confirmed.unionByName(found)


def keep_representatives(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 6, block: int = 4000) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id, one without doc_id only if all are."""
    names = docs.columns
    # keyed by a saved row number
    docs = save(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    texts = docs.select(F.col("_row").alias("row"), F.col("text").cast("string").alias("text"))
    each = save(sketches(texts, shingle, bands, rows), "sketches")
    firsts = save(each.groupBy("k1", "k2").agg(F.min("row").alias("rep")), "sets")
    distinct = each.join(firsts.select(F.col("rep").alias("row")), "row", "left_semi")
    comps = connected_components(links(texts, distinct, shingle, threshold, block), "a", "b")
    comps = comps.withColumnRenamed("id", "rep")
    firsts = save(firsts.join(comps, "rep", "left").select("k1", "k2", F.coalesce("component_id", "rep").alias("c")), "labels")
    mine = each.select("row", "k1", "k2").join(firsts, ["k1", "k2"]).select("row", "c")
    mine = save(mine.join(docs.select(F.col("_row").alias("row"), "doc_id"), "row"), "groups")
    stays = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays")
    best = save(mine.groupBy("c").agg(stays, F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "stays"), "stays")
    gone = mine.join(maybe_broadcast(best, 1_000_000), "c").where("row <> stays").select(F.col("row").alias("_row"))
    gone = save(gone, "gone")
    return docs.join(maybe_broadcast(gone, 1_000_000), "_row", "left_anti").select(*names)
