"""Folds and bounded samples of labelled rows, drawn by hash so that every run draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)), F.lit(0))


#: Bytes of text that are learned from at most, of each label.
MOST_BYTES = 64 << 20


def drawn(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """(key, label): at most ``most`` rows of each label, by the hash of the key.

    Only keys and labels move.  A key with several labels has the smallest.  Of
    a label with many rows those whose hash is in a share of its range are
    ranked, four times ``most`` rows or so.
    """
    rows = labels.select(key, label).dropna().groupBy(key).agg(F.min(label).alias(label)).withColumn("_hash", F.xxhash64(key))
    share = rows.groupBy(F.col(label).alias("_of")).agg((F.lit(4.0 * most) / F.count(F.lit(1))).alias("_share"))
    near = rows.join(F.broadcast(share), F.col(label) == F.col("_of")).filter(F.pmod("_hash", F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    first = Window.partitionBy(label).orderBy("_hash", key)
    return near.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= most).select(key, label)


def texts_of(docs: DataFrame, sample: DataFrame, key: str, text: str, label: str, most_bytes: int = MOST_BYTES) -> list[tuple[str, object]]:
    """The texts (null as empty) and labels of a bounded sample, in an order of its own.

    The sample is what :func:`drawn` bounds, so it can be broadcast.  Of the
    rows of a key the smallest text is taken, and of a label no more texts than
    ``most_bytes`` hold, by the hash of the key (one at least): that is what is collected.
    """
    picked = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    of = F.broadcast(sample.select(F.col(key).alias("_of"), F.col(label).alias("_label")))
    one = picked.join(of, F.col("_key") == F.col("_of")).groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    so_far = Window.partitionBy("_label").orderBy(F.xxhash64("_key"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    held = one.withColumn("_before", F.coalesce(F.sum(F.octet_length("_text")).over(so_far), F.lit(0)))
    rows = held.filter((F.col("_before") == 0) | (F.col("_before") + F.octet_length("_text") <= most_bytes)).select("_key", "_text", "_label").collect()
    return [(r["_text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["_key"], r["_text"]))]
