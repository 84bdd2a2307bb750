"""SimHash near-dedup by a binary-trie self-join.

Fingerprints: the text's A-Z in lower case, words between ASCII white space, shingles of `shingle` words joined by
one space, XXH64 (seed 42) of each; a bit is 1 if it is set in over half of the hashes.

Links (at most `budget` differing bits): only distinct fingerprints meet. With budget + 1 blocks of bits, two
linked fingerprints agree in a block at least, so each fingerprint goes once to each of its blocks; within a
block's group the fingerprints, block first, form a binary trie that is joined with itself: pairs of nodes go
down together, a bit at a time, gather differing bits and end when these exceed the budget. Groups above
`max_group` are divided by blocks of their remaining bits, and once more (`DIVISIONS`); what is still together then agrees in
half of its bits. A task returns a spanning forest of its links,
never all pairs; components come from the forests.

Defined cases: null, empty and wordless texts have fingerprint 0; rows are judged one by one, so repeated
rows each come back; a null doc_id takes no part in links (its component_id is null); other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, merge_labels, save, whole_groups
from .components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PAIRS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 1 << 17  # fingerprints of whole groups that a task joins at once
DIVISIONS = 2


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    body, ends, at = b" ".join(words), [], -1
    for w in words:
        ends.append(at := at + len(w) + 1)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    return np.fromiter((digest(body[i:j], seed) for i, j in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(group: np.ndarray, fp: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the same group within the budget. group and fp (uint64) are sorted together, no repeats."""
    n = len(fp)
    cut = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if n else np.zeros(0, int)
    lo, hi = cut, np.append(cut[1:], n)
    many = hi - lo > 1
    stack = [(63, np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, front = stack.pop()
        if front.shape[1] > PAIRS_AT_ONCE:
            stack += [(bit, part) for part in np.array_split(front, front.shape[1] // PAIRS_AT_ONCE + 1, axis=1)]
            continue
        al, ah, bl, bh, d = front
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            a, b = al[leaf], bl[leaf]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
            if near.any():
                yield a[near], b[near]
            al, ah, bl, bh, d = front[:, ~leaf]
        if not len(al) or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm, same = ah - (ones[bit][ah] - ones[bit][al]), bh - (ones[bit][bh] - ones[bit][bl]), al == bl
        down = [np.stack(x) for x in ((al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1))]
        down.append(np.stack((am, ah, bl, bm, d + 1))[:, ~same])
        front = np.concatenate(down, axis=1)
        al, ah, bl, bh, d = front
        stack.append((bit - 1, front[:, (ah > al) & (bh > bl) & (d <= budget) & ~((al == bl) & (ah - al == 1))]))


def _forest(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g", ROWS_AT_ONCE):
            g, fp, rep = (t.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, g))
            g, fp, rep = g[order], fp[order], rep[order]
            label = np.arange(len(fp))
            for a, b in trie_pairs(g, fp, budget):
                label = merge_labels(label, a, b)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], ["a", "b"])

    return run


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row once for each block of its `left` low bits: that block moves to their top and is done with.

    rows: rep, g, fp, left. Rows that agree in what is done with share g, and their bits have moved alike.
    """
    parts = []
    for i in range(blocks):
        lo, hi = f"cast(({i} * left) div {blocks} as int)", f"cast(({i + 1} * left) div {blocks} as int)"
        ones = lambda n: f"(shiftleft(1L, {n}) - 1)"
        own = f"(shiftrightunsigned(fp, {lo}) & {ones(f'{hi} - {lo}')})"
        rest = f"(shiftleft(shiftrightunsigned(fp, {hi}) & {ones(f'left - {hi}')}, {lo}) | (fp & {ones(lo)}))"
        done = "if(left = 64, 0L, shiftleft(shiftrightunsigned(fp, left), left))"
        moved = f"{done} | shiftleft({own}, left - ({hi} - {lo})) | {rest}"
        parts.append(f"named_struct('g', xxhash64(g, {i}, {own}), 'fp', {moved}, 'left', left - ({hi} - {lo}))")
    return rows.select("rep", F.expr(f"explode(array({', '.join(parts)}))").alias("r")).select("rep", "r.*")


def fingerprint_links(fps: DataFrame, budget: int = 4, max_group: int = 200_000) -> DataFrame:
    """(a, b): links, between the representatives of distinct fingerprints, that span all links. fps: (fp, rep)."""
    rows = fps.select("rep", F.lit(0).cast("long").alias("g"), "fp", F.lit(64).alias("left"))
    out = None
    for level in range(DIVISIONS + 1):
        spread = _blocks(rows, budget + 1)
        hot = save(spread.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group).select("g"), "hot")
        some = level < DIVISIONS and hot.limit(1).count()
        cold = spread.join(maybe_broadcast(hot, 100_000), "g", "left_anti") if some else spread
        found = cold.select("g", "fp", "rep").repartition("g").sortWithinPartitions("g").mapInArrow(_forest(budget), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not some:
            return out
        # groups that are too large go on by blocks of their remaining bits
        rows = save(spread.join(maybe_broadcast(hot, 100_000), "g", "left_semi"), "rows")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, max_group: int = 200_000) -> DataFrame:
    """docs' other columns kept aside: (doc_id, fp, fingerprint hex, component_id), one row per row of docs."""
    each = save(fingerprints(docs, shingle), "fingerprints")
    fps = save(each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    comps = connected_components(fingerprint_links(fps, budget, max_group), "a", "b")
    fps = fps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = each.join(fps, "fp", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), comp)


def keep_representatives(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id. Rows without doc_id stay."""
    gone = near_duplicates(docs, **how).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
