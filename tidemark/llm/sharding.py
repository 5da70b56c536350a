"""Shards of shuffled rows by an external shuffle in two passes.

Pass one scatters the rows by a seeded hash over buckets that fit in memory;
pass two shuffles each bucket (Fisher-Yates) and writes it.  The buckets, one
after the other, are one random order of all rows; every shard is an equal
stretch of it, so the shards' counts differ by one at most and a bucket is
written to one shard, or two where it lies across a border.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.scratch import shared_dir, written

SHARDS = 8
SEED = 13
#: What a bucket holds about: bytes of text, and rows.
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 100_000
#: A bucket of so many times its share has rows that are the same in key and text.
CROWDED = 4


def text_size(text: Column) -> Column:
    """UTF-8 bytes (none of null) and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def scattered(docs: DataFrame, buckets: int, rows: int, key: str, text: str, seed: int) -> DataFrame:
    """(row, hash, bucket): pass one.

    The bucket comes from a hash of seed, key and text.  Rows that are the same
    in both can crowd a bucket however many there are; the rows of such buckets
    are stored with their places and scattered by these too.
    """
    hashed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("hash"))
    tagged = hashed.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    most = CROWDED * max(1, -(-rows // buckets))
    crowded = written(tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("bucket"), "crowded")
    if buckets == 1 or crowded.isEmpty():
        return tagged
    side = F.broadcast(crowded)  # at most a bucket in CROWDED
    spread = written(tagged.join(side, "bucket", "left_semi").withColumn("at", F.monotonically_increasing_id()), "spread")
    again = spread.select("row", "hash", F.pmod(F.xxhash64(F.lit(seed), "hash", "at"), F.lit(buckets)).alias("bucket"))
    return tagged.join(side, "bucket", "left_anti").select("row", "hash", "bucket").unionByName(again)


def shard_starts(rows: int, shards: int) -> list[int]:
    """Where each shard begins in the order of all rows, and the end."""
    return [rows * s // shards for s in range(shards + 1)]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of ``docs``, whole, as Parquet below ``path``, a folder a shard; returns them as read from there.

    Rows have their columns and ``shard`` and ``slot``, their place in the shard
    from 0 without gaps; files are in the order of slots.  Columns of these
    names are replaced.  The same rows and seed give the same shards, however
    they are partitioned, unless more rows are equal in key and text than a
    bucket takes: they are then dealt by where they are read.  Null keys and
    texts are values like others; rows of one key stay apart.  Without rows the
    result is empty.  What the driver collects is the number of rows of each
    bucket, a row for 32 MB of text or 100,000 rows.
    """
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text_size(F.col(text))), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes), -(-total["n"] // bucket_rows))
    rows = scattered(docs, buckets, total["n"], key, text, seed)
    counts = sorted((r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().collect())
    firsts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(np.int64)
    spark = docs.sparkSession
    at = F.broadcast(spark.createDataFrame([(b, int(firsts[i])) for i, (b, _) in enumerate(counts)], "of bigint, first bigint"))
    starts = np.array(shard_starts(int(firsts[-1]), shards))

    def shuffled(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("hash")
        number, first, n = bucket.column("bucket")[0].as_py(), bucket.column("first")[0].as_py(), bucket.num_rows
        order = np.random.default_rng([seed, number]).permutation(n)
        place = first + np.arange(n)
        shard = np.searchsorted(starts, place, "right") - 1
        held = bucket.column("row").take(pa.array(order))
        return pa.table([held, pa.array(shard.astype(np.int32)), pa.array(place - starts[shard])], ["row", "shard", "slot"])

    kind = StructType([rows.schema["row"], StructField("shard", IntegerType()), StructField("slot", LongType())])
    dealt = rows.join(at, F.col("bucket") == F.col("of")).select("row", "hash", "bucket", "first").groupBy("bucket").applyInArrow(shuffled, kind)
    flat = dealt.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot")
    flat.write.partitionBy("shard").options(compression="zstd").parquet(path)
    return spark.read.schema(flat.schema).parquet(path).select(*flat.columns)


def sharded_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as shards and describes each row as it is read back; the law of the shards is ``rows``."""
    stored = write_shards(docs.select(key, text), f"{shared_dir(docs.sparkSession)}/shards", key=key, text=text)
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return stored.select(key, text_size(F.col(text)).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
