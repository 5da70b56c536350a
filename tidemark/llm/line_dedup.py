"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every run of three lines is hashed; runs that occur anywhere else in the corpus
are found by their hash; every occurrence but the first is covered, and the
covered lines of a document, merged, are cut out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrence() -> Column:
    """What orders the occurrences of a window: key (null last), the text's hash for rows of one key, line."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "tag", "line")


def windows(docs: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """(id, tag, line, hash): each run of ``size`` lines, by its first line."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("lines") - size),
        lambda at: F.unhex(F.md5(F.array_join(F.slice("lines", at + 1, size), "\n"))),
    )
    return (
        docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("tag"), _lines(F.col(text)).alias("lines"))
        .filter(F.size("lines") >= size)
        .select("id", "tag", F.posexplode(hashes).alias("line", "hash"))
    )


def later_windows(docs: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """(id, tag, covered): the sorted first lines of windows that have occurred before."""
    every = written(windows(docs, key, text, size), "windows")
    first = every.groupBy("hash").agg(F.min(_occurrence()).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = every.join(written(first, "first"), "hash").filter(_occurrence() != F.col("first"))
    return later.groupBy("id", "tag").agg(F.sort_array(F.collect_set("line")).alias("covered"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, name: str = "line_dedup") -> DataFrame:
    """``docs`` with every later occurrence of a run of ``size`` lines removed from ``text``.

    Lines end at ``\\n`` only and are compared as they are.  The first
    occurrence, by key (null keys last) and line, keeps its lines; of rows with
    the same key and text all are the same occurrence.  A text of fewer than
    ``size`` lines, an empty one and a null one stay as they are; a text whose
    lines all go becomes empty.  Only ``text`` changes; further columns pass,
    whatever their names, and n_lines and n_removed follow in a struct column
    ``name`` (of two columns of this name the new one replaces the old).
    """
    covered = later_windows(docs, key, text, size).select(F.struct("id", "tag").alias("_at"), F.col("covered").alias("_covered"))
    row = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("tag"))
    columns = [c for c in docs.columns if c != name]
    held = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), row.alias("_here"))
    joined = held.join(covered, F.col("_here").eqNullSafe(F.col("_at")), "left")
    lines, at = _lines(F.col(f"_row.{text}")), F.col("_covered")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i - 1) + size)
    end = lambda i: F.when(i == F.size(at), F.size(lines)).otherwise(F.get(at, i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(lines, start(i) + 1, F.greatest(F.lit(0), end(i) - start(i)))))
    kept = F.when(at.isNull(), lines).otherwise(kept)
    shown = joined.select("_row", at.isNull().alias("_whole"), F.size(lines).alias("_n"), kept.alias("_kept"))
    new = F.when(F.col("_whole"), F.col(f"_row.{text}")).otherwise(F.array_join("_kept", "\n"))
    counts = F.struct(F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_kept")).alias("n_removed"))
    return shown.select(*[new.alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in columns], counts.alias(name))
