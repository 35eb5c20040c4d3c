"""Prefix tries as tables of edges, and scores pooled below them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..sources.shared import scratch

#: Buckets of a stored tree at each depth.
BUCKETS = 32

_STORED = "prefix array<int>, next int, depth int"


def edges(codes: DataFrame, *group: str) -> DataFrame:
    """Distinct (group..., prefix, next) of all codes."""
    return codes.select(*group, F.explode(C.edges(F.col("codes"))).alias("e")).select(*group, "e.prefix", "e.next").distinct()


def store(codes: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The tree of all codes on files, as :func:`stored` gives it.

    It is partitioned by depth and bucketed by prefix, so that a step of a search
    reads one depth, and a join by prefix does not send the tree anywhere.
    """
    path, table = path or scratch(codes.sparkSession, "tree"), f"tree_{uuid.uuid4().hex}"
    tree = edges(codes).withColumn("depth", F.size("prefix"))
    # one file for each bucket of a depth
    by_bucket = tree.repartition(buckets, "prefix")
    by_bucket.write.partitionBy("depth").bucketBy(buckets, "prefix").option("path", path).saveAsTable(table)
    return codes.sparkSession.table(table)


def stored(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(prefix, next, depth) that :func:`store` wrote, in another session too."""
    table = f"tree_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({_STORED}) USING parquet PARTITIONED BY (depth) CLUSTERED BY (prefix) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def query_edges(run: DataFrame, codes: DataFrame) -> DataFrame:
    """The trie of each query's own candidates; joined before prefixes multiply the rows."""
    return edges(run.select("qid", "docid").join(codes, "docid"), "qid")


def pooled(run: DataFrame, codes: DataFrame, how: str = "max") -> DataFrame:
    """(qid, prefix, next, lex): candidates' scores pooled below each edge."""
    rows = run.join(codes, "docid").select("qid", "score", F.explode(C.edges(F.col("codes"))).alias("e"))
    agg = {"max": F.max, "min": F.min, "mean": F.avg}[how]
    return rows.groupBy("qid", "e.prefix", "e.next").agg(agg("score").alias("lex"))


def look_up(trie: DataFrame, prefixes: DataFrame, end: int = 1) -> DataFrame:
    """The allowed next codes of each prefix; ``end`` if there are none."""
    return prefixes.join(trie, "prefix", "left").select("prefix", F.coalesce("next", F.lit(end)).alias("next"))


def leaves(trie: DataFrame) -> DataFrame:
    """Sequences that are no prefix of another."""
    whole = trie.select(F.concat("prefix", F.array("next")).alias("codes"))
    return whole.join(trie.select(F.col("prefix").alias("codes")).distinct(), "codes", "left_anti")


def by_smtid(codes: DataFrame, length: int) -> DataFrame:
    """(smtid, docid) with the first ``length`` codes as a string."""
    return codes.select(C.to_string(C.prefix(F.col("codes"), length)).alias("smtid"), "docid")


def smtid_scores(run: DataFrame, codes: DataFrame, length: int) -> DataFrame:
    """(qid, smtid, score): the best document of each code string."""
    return run.join(by_smtid(codes, length), "docid").groupBy("qid", "smtid").agg(F.max("score").alias("score"))


def smtid_qrels(qrels: DataFrame, codes: DataFrame, length: int) -> DataFrame:
    """(qid, smtid, rel): judgments by code string, the highest on a collision."""
    return qrels.join(by_smtid(codes, length), "docid").groupBy("qid", "smtid").agg(F.max("rel").alias("rel"))
