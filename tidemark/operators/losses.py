"""Losses and diagnostics of contrastive batches: (batch, id, view, vector), two views of each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.views import cosine


def in_batches(table: DataFrame, size: int, key: str = "id") -> DataFrame:
    """``table`` with batch: ids, which are numbers, in batches of ``size`` at most by range."""
    return table.withColumn("batch", F.floor(F.col(key) / size))


def _pairs(views: DataFrame) -> DataFrame:
    """The pairs of vectors of a batch, which is of a bounded size, without those of a vector with itself; sim is their cosine."""
    a, b = (views.select("batch", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "view", "vector")]) for side in "ab")
    apart = (F.col("id_a") != F.col("id_b")) | (F.col("view_a") != F.col("view_b"))
    return a.join(b, "batch").filter(apart).withColumn("sim", cosine(F.col("vector_a"), F.col("vector_b")))


def nt_xent(views: DataFrame, temperature: float = 0.2) -> DataFrame:
    """(batch, loss): the mean cross entropy of telling a vector's other view from all other vectors of its batch.

    Similarities are cosines by ``temperature``.  A batch of fewer than two ids has no loss.
    """
    logit = F.col("sim") / temperature
    rows = _pairs(views).groupBy("batch", "id_a", "view_a").agg(F.max(logit).alias("_top"), F.max(F.when(F.col("id_a") == F.col("id_b"), logit)).alias("_own"), F.collect_list(logit).alias("_all"), F.count_distinct("id_b").alias("_ids"))
    log_sum = F.col("_top") + F.log(F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))
    return rows.filter(F.col("_ids") > 1).groupBy("batch").agg(F.avg(log_sum - F.col("_own")).alias("loss"))


def consistency(a: Column, b: Column) -> Column:
    """How far two vectors point apart."""
    return 1 - cosine(a, b)


def combined_loss(time: DataFrame, frequency: DataFrame, first: DataFrame, second: DataFrame, share: float = 0.5) -> DataFrame:
    """(batch, loss): ``share`` of both contrastive losses, and the rest of the mean of both consistency losses; all are (batch, loss)."""
    held = time.select("batch", F.col("loss").alias("t"))
    for name, table in (("f", frequency), ("a", first), ("b", second)):
        held = held.join(table.select("batch", F.col("loss").alias(name)), "batch")
    return held.select("batch", (share * (F.col("t") + F.col("f")) + (1 - share) * (F.col("a") + F.col("b")) / 2).alias("loss"))


def batch_diagnostics(views: DataFrame) -> DataFrame:
    """(batch, mean_std, mean_norm, positive_cosine, negative_cosine): spread over the batch, averaged over dimensions; cosines of the two views of an id and of different ids."""
    dims = views.select("batch", F.posexplode("vector").alias("at", "x")).groupBy("batch", "at").agg(F.stddev_samp("x").alias("s")).groupBy("batch").agg(F.avg("s").alias("mean_std"))
    norms = views.groupBy("batch").agg(F.avg(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("mean_norm"))
    own = F.col("id_a") == F.col("id_b")
    cosines = _pairs(views).groupBy("batch").agg(F.avg(F.when(own, F.col("sim"))).alias("positive_cosine"), F.avg(F.when(~own, F.col("sim"))).alias("negative_cosine"))
    return dims.join(norms, "batch").join(cosines, "batch", "left")
