"""Corpora as one contract: texts (target, repo_dir, text_file, source_file, raw_text, fallback_piece_id).

`page_marked_tree` reads a tree of page-marked files through Spark, so any store that Spark reads will do;
`documents_corpus` takes any table with a text column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import lines, newlines, strip
from ..operators.fragments import first_fragments, fragment_rows, title
from ..operators.scope import REPO, normalize_scope

# fixed values
SECTION, ENTRY = r"^\*\s+KR[1-4]\s+(.+)$", r"^\*\*\s+\[\[file:(KR[1-4][a-z])\.txt\]\[([^\]]+)\]\]$"
NO_SECTION = "未分类"


def _decode(files: DataFrame) -> DataFrame:
    """(path, text): bytes that aren't UTF-8 are dropped, newlines are universal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if c is None else c.decode("utf-8", "ignore") for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string").withColumn("text", newlines(F.col("text")))


def scope_dirs(spark: SparkSession, root: str) -> DataFrame:
    """(repo_dir): the root's folders that are named like repositories, empty ones included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in names], "repo_dir string").where(F.col("repo_dir").rlike(REPO))


def page_marked_tree(spark: SparkSession, root: str, targets: DataFrame) -> DataFrame:
    """The texts of the targets' (token, repo_dirs) repositories: only their folders are listed and read."""
    wanted = [r[0] for r in targets.select(F.explode("repo_dirs")).distinct().collect()]  # folder names
    if not wanted:
        return spark.createDataFrame([], "target string, repo_dir string, text_file string, source_file string, raw_text string, fallback_piece_id string")
    return _texts(spark, [f"{root}/{d}" for d in sorted(wanted)], targets)


def _texts(spark: SparkSession, paths: list[str], targets: DataFrame) -> DataFrame:
    """The texts of folders or files, for each target that holds their repository."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(paths)
    t = _decode(files).withColumn("repo_dir", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    t = t.withColumn("text_file", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("stem", F.regexp_replace("text_file", r"\.txt$", ""))
    t = t.join(targets.select(F.col("token").alias("target"), F.explode("repo_dirs").alias("repo_dir")), "repo_dir")
    return t.select("target", "repo_dir", "text_file", title(F.col("text"), F.col("stem")).alias("source_file"), F.col("text").alias("raw_text"), F.concat("stem", F.lit("_fallback_0001")).alias("fallback_piece_id"))


def chosen_files(spark: SparkSession, root: str, targets: DataFrame, limit: int) -> dict[str, list[str]]:
    """For each target the first files, by repository and name, that hold `limit` fragments together; the first one at least.

    Names are listed, no more files read than doubling needs: 1, then 2, 4, ... of each target that still lacks fragments. A
    file is counted once, by one job for all targets of a turn.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    left, out, have = {}, {}, {}
    for t in targets.select("token", "repo_dirs").collect():  # names only
        names = []
        for d in sorted(t.repo_dirs):
            folder = fs_path(f"{root}/{d}")
            fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(folder):
                names += [f"{d}/{n}" for n in sorted(s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".txt")]
        left[t.token], out[t.token], have[t.token] = names, [], 0
    width, counts = 1, {}
    while True:
        turn = {t: names[:width] for t, names in left.items() if names and (not out[t] or have[t] < limit)}
        if not turn:
            return out
        new = sorted({f for names in turn.values() for f in names} - counts.keys())
        if new:
            one = spark.createDataFrame([("", sorted({f.split("/")[0] for f in new}))], "token string, repo_dirs array<string>")
            found = fragment_rows(_texts(spark, [f"{root}/{f}" for f in new], one)).groupBy("repo_dir", "text_file").count().collect()
            counts |= dict.fromkeys(new, 0) | {f"{r.repo_dir}/{r.text_file}": r["count"] for r in found}
        for t, names in turn.items():
            for f in names:
                if out[t] and have[t] >= limit:
                    break
                out[t].append(f)
                have[t] += counts[f]
            left[t] = left[t][len(names) :]
        width *= 2


def first_fragments_of_tree(spark: SparkSession, root: str, targets: DataFrame, limit: int) -> DataFrame:
    """The first `limit` fragments of each target by repository, file and page: only the files that hold them are scanned."""
    chosen = chosen_files(spark, root, targets, limit)
    pairs = [(t, *f.split("/")) for t, names in chosen.items() for f in names]
    if not pairs:
        return fragment_rows(page_marked_tree(spark, root, targets.where("false")))
    texts = _texts(spark, sorted({f"{root}/{d}/{n}" for _, d, n in pairs}), targets)
    own = spark.createDataFrame(pairs, "target string, repo_dir string, text_file string")
    return first_fragments(fragment_rows(texts.join(F.broadcast(own), ["target", "repo_dir", "text_file"], "left_semi")), ["target"], ["repo_dir", "text_file", "pos"], limit)


def documents_corpus(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source): the source is the target, the language the repository, a document a file."""
    name = F.format_string("%08d", "doc_id")
    return docs.select(F.col("source").alias("target"), F.col("lang").alias("repo_dir"), name.alias("text_file"), F.col("source").alias("source_file"), F.col("text").alias("raw_text"), F.concat(name, F.lit("_fallback_0001")).alias("fallback_piece_id"))


def catalog_entries(files: DataFrame) -> DataFrame:
    """(code, section, label) of catalogue files (file_no, text): an entry belongs to the last section line above it.

    A code counts once, in its first file and line. A catalogue file is a short list, so a file is one row.
    """
    numbered = files.select("file_no", F.posexplode(lines(F.col("text"))).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    section = F.regexp_extract("line", SECTION, 1)
    from pyspark.sql import Window as W

    above = F.last(F.nullif(strip(section), F.lit("")), ignorenulls=True).over(W.partitionBy("file_no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    e = numbered.withColumn("section", above).withColumn("code", normalize_scope(F.regexp_extract("line", ENTRY, 1))).where("code <> ''")
    e = e.select("code", F.coalesce("section", F.concat(F.lit("KR"), F.col("file_no").cast("string"))).alias("section"), strip(F.regexp_extract("line", ENTRY, 2)).alias("label"), "file_no", "pos")
    from ..operators.dedupe import first_wins

    return first_wins(e, ["code"], ["file_no", "pos"])


def scope_options(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """The catalogue's entries, or, where it has none, the families of the folders."""
    families = dirs.select(F.substring("repo_dir", 1, 4).alias("code")).distinct()
    none = entries.limit(1).count() == 0
    out = families.select("code", F.lit(NO_SECTION).alias("section"), F.col("code").alias("label")) if none else entries.select("code", "section", "label")
    return out.withColumn("display_label", F.concat("section", F.lit(" ["), "label", F.lit("]")))
