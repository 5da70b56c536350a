"""Batches of vehicles and prefixes for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import ranked
from tidemark.operators.sequences import hash_number


#: Rounds of a permutation.
ROUNDS = 20


def shuffled_place(place: Column, n: Column, seed: int, *name: Column) -> Column:
    """A permutation of 0 to ``n`` - 1, drawn by seed and name: where ``place`` goes.

    In each round a place and its mirror image about a drawn point change or
    keep their places, by a bit drawn for the two; so no place needs to know any
    other one, whatever ``n``.
    """
    of = lambda *more: hash_number(seed, F.concat_ws(":", *[x.cast("string") for x in (*name, *more)]))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(of(F.lit(i)), n).alias("at")) for i in range(1, ROUNDS + 1)])

    def round_(v: Column, p: Column) -> Column:
        mirror = F.pmod(p["at"] - v, n)
        return F.when(of(p["i"], F.greatest(v, mirror)) % 2 == 1, mirror).otherwise(v)

    return F.aggregate(points, place.cast("bigint"), round_)


def _spread(ranks: DataFrame) -> DataFrame:
    """Ranks dealt to tasks: few bytes a row, so they would be in few tasks, but working out places takes time."""
    spark = ranks.sparkSession
    return ranks.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vehicle_id")


def permuted(rows: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``rows`` with place, from 0: the order of an epoch.  Each epoch's place is worked out from a rank by hash, without another sort."""
    held = _spread(ranked(rows.select(F.col(key).alias("vehicle_id")), seed, []))
    at = held.select(F.col("vehicle_id").alias("_key"), shuffled_place(F.col("_r") - 1, F.col("_n"), seed, F.lit("epoch"), F.lit(epoch)).alias("place"))
    return rows.drop("place").join(at, F.col(key) == F.col("_key")).drop("_key")


def loaded(rows: DataFrame, key: str, size: int, seed: int = 42, epochs: int = 1) -> DataFrame:
    """(epoch, batch, place, ``key``): every epoch's batches of ``size`` rows, in an order of its own; the last batch may have fewer.

    Keys are unique.  A batch of any epoch can be read by itself, from the ranks.
    """
    held = ranked(rows.select(F.col(key).alias("vehicle_id")), seed, []).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    at = shuffled_place(F.col("_r") - 1, F.col("_n"), seed, F.lit("epoch"), F.col("epoch"))
    return held.select("epoch", at.alias("_at"), F.col("vehicle_id").alias(key)).select("epoch", F.floor(F.col("_at") / size).alias("batch"), (F.col("_at") % size).alias("place"), key)


def event_batches(vehicles: DataFrame, size: int = 32, events: int = 8, seed: int = 42, drop_last: bool = False, epoch: int = 0) -> DataFrame:
    """(batch, place, vehicle_id, event): an epoch of batches, each with ``events`` events and censored rows for the rest.

    Events are dealt out once, in an order drawn by seed and epoch; the last
    batch may have fewer, unless ``drop_last``.  Censored rows are dealt out in
    whole shares of ``size`` - ``events``; once fewer are left, all of them are
    shuffled anew and dealt again.  Null events count as censored.
    """
    if not 0 < events < size:
        raise ValueError("events must be positive and less than size")
    share = size - events
    held = ranked(vehicles.select("vehicle_id", F.coalesce(F.col("event") == 1, F.lit(False)).cast("int").alias("event")), seed, ["event"]).withColumn("_r", F.col("_r") - 1)
    counts = held.agg(F.coalesce(F.max(F.when(F.col("event") == 1, F.col("_n"))), F.lit(0)).alias("e"), F.coalesce(F.max(F.when(F.col("event") == 0, F.col("_n"))), F.lit(0)).alias("c"))
    batches = F.floor(F.col("e") / events) if drop_last else F.ceil(F.col("e") / events)
    enough = F.when(F.floor(F.col("c") / share) < 1, F.raise_error(F.lit("too few censored rows for a batch")).cast("bigint")).otherwise(F.floor(F.col("c") / share))
    rows = held.crossJoin(F.broadcast(counts.select(batches.cast("bigint").alias("_batches"), enough.alias("_shares"))))
    dead = F.col("event") == 1
    passes = F.when(dead, F.lit(1).cast("bigint")).otherwise(F.ceil(F.col("_batches") / F.col("_shares")))
    again = _spread(rows.filter("_batches > 0")).withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
    at = shuffled_place(F.col("_r"), F.col("_n"), seed, F.lit(epoch), F.col("event"), F.col("_pass"))
    chunk = again.withColumn("_chunk", F.floor(at / F.when(dead, events).otherwise(share)).cast("bigint"))
    whole = chunk.filter(dead | (F.col("_chunk") < F.col("_shares"))).withColumn("batch", F.col("_pass") * F.col("_shares") + F.col("_chunk"))
    inside = Window.partitionBy("batch").orderBy(hash_number(seed, F.concat_ws(":", F.lit(epoch), "batch", "vehicle_id")), "vehicle_id")
    return whole.filter(F.col("batch") < F.col("_batches")).select("batch", (F.row_number().over(inside) - 1).alias("place"), "vehicle_id", "event")


def collated(packed: DataFrame, columns: list[str], key: str = "vehicle_id") -> DataFrame:
    """``packed`` rows (batch, ``key``, sequence_length, arrays) with their arrays filled with 0 up to the longest of the batch, and padding_mask: true where a value is."""
    longest = F.max("sequence_length").over(Window.partitionBy("batch"))
    held = packed.withColumn("_longest", longest)
    wide = {c: F.concat(F.col(c), F.array_repeat(F.lit(0.0), F.col("_longest") - F.col("sequence_length"))) for c in columns}
    mask = F.transform(F.sequence(F.lit(1), F.col("_longest")), lambda i: i <= F.col("sequence_length"))
    return held.withColumns(wide).withColumn("padding_mask", mask).select("batch", key, "sequence_length", *columns, "padding_mask")


def survival_dataset(sequences: DataFrame) -> DataFrame:
    """One row a vehicle: index by id, its length and targets, weight 1 and no pseudo label where ``sequences`` have no such columns."""
    more = {"sample_weight": F.lit(1.0), "is_pseudo": F.lit(False)}
    held = sequences.withColumns({c: v for c, v in more.items() if c not in sequences.columns})
    one = held.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("sequence_length"), *[F.max(c).alias(c) for c in ("duration", "event", *more)])
    return ordered_dataset(one, "vehicle_id")


def ordered_dataset(table: DataFrame, key: str) -> DataFrame:
    """``table`` with index, from 0, in the order of ``key`` as text.

    Keys are counted by their first characters; rows are ranked within those.
    """
    text = F.col(key).cast("string")
    held = table.withColumn("_head", F.substring(text, 1, 3))
    counts = held.groupBy("_head").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_head", F.coalesce(F.sum("_c").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # of a row a head
    place = F.row_number().over(Window.partitionBy("_head").orderBy(text))
    return held.withColumn("_p", place).join(F.broadcast(before), "_head").withColumn("index", F.col("_p") - 1 + F.col("_b")).drop("_head", "_p", "_b")
