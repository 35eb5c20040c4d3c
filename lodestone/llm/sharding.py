"""Sharding by a uniform shuffle with exact shard sizes.

Shard sizes differ by one row at most. How many rows each partition sends to
each shard is drawn first, on the driver, from the matrix hypergeometric law
that a uniform shuffle of all rows would follow; its size is partitions times
shards and does not grow with the rows of a partition. Each task then deals its
rows to shards by a permutation of exactly those counts, rows are exchanged,
and each shard is permuted again: its rows get random keys, whose first bits
say in which of many cells of the shard a row is, and its slot is the number of
rows in earlier cells plus its rank within the cell. No task sorts a shard.

Draws follow from the seed, the partition number and the place in it, which are
written to the shared folder before they are used, so a retried task deals as
before. A null text has size 1 and the crc32 of no bytes; equal texts, repeated
keys and repeated rows are dealt like any others. An empty table gives no rows.
Other columns come back as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, fresh, materialize, table, whole

SHARDS = 16
#: Rows that a cell of a shard has on average, and the least number of cells.
CELL_ROWS, LEAST_CELLS = 50_000, 32
#: Rows below which numpy draws.
SMALL = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` of ``good + bad`` rows are good, of populations of any size.

    Numpy's sampler stops at 10 ** 9 rows. Beyond, the probabilities around the
    mode follow from ratios of neighbours, as far as they are not below 1e-40 of
    it; their number is some tens of standard deviations.
    """
    if good + bad < SMALL:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = 15 * int((draws * (good / (good + bad)) * (bad / (good + bad))) ** 0.5) + 50
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1)
    ratio = np.log(np.maximum(good - k[:-1], 1)) + np.log(np.maximum(draws - k[:-1], 1)) - np.log(k[1:]) - np.log(np.maximum(bad - draws + k[1:], 1))
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(log - log.max()))
    return int(k[min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(k) - 1)])


def communication_matrix(parts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows from each partition to each shard; rows and columns sum exactly."""
    left = shard_sizes(sum(parts.values()), shards).tolist()
    drawn = {}
    for part in sorted(parts):
        rng = np.random.default_rng([seed, 0, part])
        rows, others, sent = parts[part], sum(left), []
        for room in left:
            others -= room
            sent.append(hypergeometric(rng, room, others, rows) if rows else 0)
            rows -= sent[-1]
        drawn[part] = sent
        left = [a - b for a, b in zip(left, sent, strict=True)]
    return drawn


def uniform_shards(df: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """``df`` with shard and slot; ``df`` should be narrow, as it is written.

    If ``df`` has columns of these names, the new ones have an underscore behind.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # one column, so that no name can clash
    numbered = materialize(df.select(row, F.spark_partition_id().alias("part"), place.alias("place")), "numbered")
    counted = {r["part"]: r["count"] for r in numbered.groupBy("part").count().collect()}  # one row for each partition
    counts = spark.sparkContext.broadcast(communication_matrix(counted, shards, seed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            parts, places = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            shard, key = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
            for p in np.unique(parts):
                if p not in known:
                    sent = counts.value[int(p)]
                    rng = np.random.default_rng([seed, 1, int(p)])
                    known = {int(p): (rng.permutation(np.repeat(np.arange(len(sent), dtype=np.int32), sent)), rng.integers(0, 1 << 62, sum(sent)))}
                mine = parts == p
                shard[mine], key[mine] = (x[places[mine]] for x in known[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(key)], schema=pa.schema([*batch.schema, ("shard", pa.int32()), ("key", pa.int64())]))

    fields = [*numbered.schema, T.StructField("shard", T.IntegerType()), T.StructField("key", T.LongType())]
    dealt = materialize(numbered.mapInArrow(deal, T.StructType(fields)), "dealt")
    rows = sum(counted.values())
    cells = max(LEAST_CELLS, -(-rows // (shards * CELL_ROWS)))
    dealt = dealt.withColumn("cell", F.floor(F.col("key") / F.lit(float(1 << 62)) * cells).cast("int"))
    sums = dealt.groupBy("shard", "cell").count()
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = materialize(sums.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "cells")
    rank = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "part", "place")) - 1
    ranked = dealt.withColumn("rank", rank).join(broadcast_if_small(sums), ["shard", "cell"])
    return ranked.select("row.*", F.col("shard").alias(fresh(df, "shard")), (F.col("before") + F.col("rank")).cast("long").alias(fresh(df, "slot")))


def described(text: Column) -> list[Column]:
    data = text.cast("binary")
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")]


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *described(whole("text")))
    out = uniform_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
