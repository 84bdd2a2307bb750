"""Fragments: page-marked or plain texts cut into cleaned, identified pieces. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import bind, drop_spaces, lines, strip

# fixed values
MARKER = r"<pb:([^>]+)>"
TECHNICAL = r"(?i)\bKR\d+[a-z]?\d*(?:_[A-Za-z0-9\-]+)*\b|_tls_|^pb:"
LINE_MARK = "¶"


def _bodies(text: Column) -> Column:
    """The lines worth reading, without markers and marks: no directives, blank lines or technical comments."""

    def keep(line: Column) -> Column:
        comment = line.startswith("#")
        technical = F.when(comment, strip(F.regexp_replace(line, r"^#+", "")).rlike(TECHNICAL)).otherwise(False)
        return (line != "") & ~technical

    def unmarked(line: Column) -> Column:
        return F.replace(F.when(line.contains("<pb:"), F.regexp_replace(line, MARKER, "")).otherwise(line), F.lit(LINE_MARK), F.lit(""))

    read = F.transform(F.filter(lines(text), lambda raw: ~raw.startswith("#+")), strip)
    return F.transform(F.filter(read, keep), unmarked)


def _text(bodies: Column, compact: bool) -> Column:
    return F.array_join(F.filter(F.transform(bodies, drop_spaces if compact else strip), lambda x: x != ""), "\n")


def clean_text(text: Column, compact: bool = False) -> Column:
    """The lines worth reading: no directives, blank lines, technical comments, markers or line marks."""
    return _text(_bodies(text), compact)


def clean_forms(text: Column) -> Column:
    """struct<clean, compact>: both forms of a text, whose lines are read once."""
    return bind(_bodies(text), lambda b: F.struct(_text(b, False).alias("clean"), _text(b, True).alias("compact")))


def fragment_rows(texts: DataFrame, text: str = "raw_text", fallback: str = "fallback_piece_id", compact: bool = False) -> DataFrame:
    """One row (pos, piece_id, original_text) for each page with an id and text; what stands before the first marker is lost.

    A text without markers is one piece under its fallback id.
    """
    t = F.col(text)
    ids = F.regexp_extract_all(t, F.lit(MARKER), F.lit(1))
    bodies = F.split(t, MARKER)
    pages = F.when(F.size(ids) > 0, F.arrays_zip(ids.alias("piece_id"), F.slice(bodies, F.lit(2), F.size(ids)).alias("body")))
    pages = pages.otherwise(F.array(F.struct(F.col(fallback).alias("piece_id"), t.alias("body"))))
    out = texts.select(*(c for c in texts.columns if c not in {text, fallback}), F.posexplode(pages).alias("pos", "_page"))
    out = out.withColumn("piece_id", strip(F.col("_page.piece_id"))).withColumn("original_text", clean_text(F.col("_page.body"), compact))
    return out.drop("_page").where("piece_id <> '' and original_text <> ''")


def title(text: Column, stem: Column, unnamed: str = "（未命名文献）") -> Column:
    """The text's TITLE directive up to a slash; without one, the file's stem."""
    found = F.regexp_extract(text, r"(?md)^#\+TITLE:\s*(.+)$", 1)
    name = strip(F.substring_index(strip(found), "/", 1))
    return F.when(found == "", stem).when(name == "", unnamed).otherwise(name)


def line_fragments(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as fragments of one line each: doc_id, pos, piece_id, original_text, n."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = out.withColumn("original_text", F.trim("line")).where("original_text <> ''")
    return out.select("doc_id", "pos", F.format_string("%08d-%05d", "doc_id", "pos").alias("piece_id"), "original_text", F.length("original_text").alias("n"))


def first_fragments(fragments: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` fragments of each group, in order."""
    from pyspark.sql import Window as W

    # Spark prunes each partition to its first rows before the shuffle
    return fragments.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= limit).drop("_i")
