"""Profiles and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

# Fixed values.
#: Upper ends of the buckets of best ranks.
RANK_BUCKETS = (1, 5, 10, 50, 100, 1000)
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
DIFF_EDGES = (-1.0, -0.5, -0.1, -0.05, -0.01, 0.0, 0.01, 0.05, 0.1, 0.5, 1.0)


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """(q, value) with linear interpolation; no rows without values.

    Equal values are counted first, so a frequent one is a row. Tasks sort ranges
    of the distinct values, and the ranges' sums tell where each value's rows
    begin and end in the order of all; only the ranges' sums meet in a task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranges = written(counts.orderBy("x").select("x", "n", F.spark_partition_id().alias("range")), "values")
    sums = ranges.groupBy("range").agg(F.sum("n").alias("sum"))
    before = F.sum("sum").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("sum").over(W.partitionBy()).alias("total"))  # a row for each range
    inside = F.sum("n").over(W.partitionBy("range").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    rows = ranges.withColumn("inside", inside).join(F.broadcast(sums), "range")
    rows = rows.select("x", (F.col("before") + F.col("inside") - F.col("n")).alias("first"), (F.col("before") + F.col("inside")).alias("behind"), F.explode(F.array(*map(F.lit, QUANTILES))).alias("q"), "total")
    place = F.col("q") * (F.col("total") - 1)
    rows = rows.withColumns({"low": F.floor(place), "high": F.ceil(place), "share": place - F.floor(place)})
    holds = lambda at: (F.col("first") <= F.col(at)) & (F.col(at) < F.col("behind"))
    found = rows.where(holds("low") | holds("high")).groupBy("q").agg(F.max(F.when(holds("low"), F.col("x"))).alias("a"), F.max(F.when(holds("high"), F.col("x"))).alias("b"), F.max("share").alias("share"))
    return found.select("q", (F.col("a") * (1 - F.col("share")) + F.col("b") * F.col("share")).alias("value"))


def bucket_of_rank(rank: Column) -> Column:
    """The smallest bucket end that holds the rank; 1001 beyond the last."""
    out = F.lit(1001)
    for end in reversed(RANK_BUCKETS):
        out = F.when(rank <= end, F.lit(end)).otherwise(out)
    return out


def best_ranks(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, best): the rank of the first relevant document, 1001 without one."""
    hits = ranked.join(qrels.where("rel >= 1").select("qid", "docid"), ["qid", "docid"]).groupBy("qid").agg(F.min("rank").alias("best"))
    return qrels.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("best", F.lit(1001).cast("long")).alias("best"))


def histogram(df: DataFrame, column: str, edges: tuple[float, ...] = DIFF_EDGES) -> DataFrame:
    """(bin, share): half-open bins, the last one closed; empty bins have share 0."""
    x = F.col(column)
    inside = df.where((x >= edges[0]) & (x <= edges[-1]))
    bin_ = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 2)):
        bin_ = F.when(x < edges[i + 1], F.lit(i)).otherwise(bin_)
    counts = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return full.select("bin", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))
