"""Top-k, ranks, merging and fusion of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(score: str = "score", tie: str = "docid") -> list[Column]:
    """Best first; rounded scores, so that the order of additions cannot matter."""
    return [F.round(F.col(score), 6).desc(), F.col(tie).asc()]


def with_rank(run: DataFrame, group: str | list[str] = "qid", score: str = "score", tie: str = "docid") -> DataFrame:
    return run.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order(score, tie))).cast("long"))


def top_k(run: DataFrame, k: int, group: str | list[str] = "qid", score: str = "score", tie: str = "docid") -> DataFrame:
    """The best k rows of each group; each task keeps k of a group before the shuffle."""
    return with_rank(run, group, score, tie).where(F.col("rank") <= k).drop("rank")


def merge_max(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of runs; of equal keys the largest score."""
    return reduce(DataFrame.unionByName, runs).groupBy(*keys).agg(F.max("score").alias("score"))


def concat(runs: list[DataFrame]) -> DataFrame:
    """All rows of all lists of pairs or triples, equal ones as often as they are there."""
    return reduce(DataFrame.unionByName, runs)


def merge_first_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``first``, and what only ``second`` has."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def fuse(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha * a + b for documents in both runs."""
    both = a.join(b.withColumnRenamed("score", "other"), ["qid", "docid"])
    return both.select("qid", "docid", (alpha * F.col("score") + F.col("other")).alias("score"))


def fusion_grid(a: DataFrame, b: DataFrame, alphas: list[float]) -> DataFrame:
    """:func:`fuse` for each alpha, from one join."""
    both = a.join(b.withColumnRenamed("score", "other"), ["qid", "docid"])
    return both.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).select("alpha", "qid", "docid", (F.col("alpha") * F.col("score") + F.col("other")).alias("score"))


def drop_self_match(run: DataFrame) -> DataFrame:
    return run.where(F.col("qid") != F.col("docid"))
