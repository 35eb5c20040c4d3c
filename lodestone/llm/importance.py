"""Importance resampling towards a target distribution by an external sort-count.

A text's features are its runs of 1 to RUN words, each in one of BUCKETS buckets
by the CRC-32 of its bytes. A first pass over a table writes the features as
streams: rows of packed uint16 buckets of several whole texts with the offset of
each text. Counting reads the streams, sorts each, encodes its runs of equal
buckets by length, and merges the runs; Spark adds the tasks' runs up by bucket.
A bucket's gain compares its share among the target's features with that among
all documents', both smoothed by one. A second pass over the written streams
gathers the gains and adds them up between the offsets by ``np.add.reduceat``;
no text is read or cut into words again.

A document's score is its weight plus a Gumbel draw from a hash of its key, so
that the best scores are a sample without replacement by weight. Those that have
``least_words`` words are ranked over ranges of rows; no task holds them all.

A null text counts as empty; a text without words has weight 0 and is never
drawn. A null key is drawn for as an empty one and comes last among ties. Rows
that repeat a key are rows of their own, ties of a key go by features and words.
An empty target gives the gains of zero counts; an empty table gives no rows. A
text of any length is counted whole: its stream is one row of two bytes for each
feature, coded in segments of words. Other columns, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import numbered
from . import grams
from .common import materialize, release, slices, table, whole

BUCKETS, RUN = 10_000, 3
SEED, PERCENT, LEAST_WORDS = "42", 5, 20


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the features of all texts in turn, words of each text)."""
    found = grams.words(texts)
    counts = found.counts()
    left = np.repeat(found.first[1:], counts) - np.arange(len(found.starts))  # words from each to its text's end
    stream = np.empty(int(np.maximum(counts, 0).sum() + np.maximum(counts - 1, 0).sum() + np.maximum(counts - 2, 0).sum()), np.uint16)
    at = 0
    for low, codes in grams.runs(found, RUN):
        rest = left[low : low + len(codes[0])]
        there = np.stack([rest > k for k in range(RUN)], axis=1)
        part = (np.stack(codes, axis=1) % np.uint32(BUCKETS)).astype(np.uint16)[there]
        stream[at : at + len(part)] = part
        at += len(part)
    return stream, counts


def features_of(words: np.ndarray) -> np.ndarray:
    return sum(np.maximum(words - k, 0) for k in range(RUN))


def streams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ids, words and offsets of several texts, and ``stream``, their features as packed uint16, for each slice of about 1 MB of text."""
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("data"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            stream, words = buckets_of(part.column(1).to_pylist())
            offsets = np.cumsum(features_of(words)) - features_of(words)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            numbers = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (words, offsets)]
            yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array([stream.tobytes()], pa.binary())], ["ids", "words", "offsets", "stream"])

    return rows.mapInArrow(run, f"ids array<{kind}>, words array<bigint>, offsets array<bigint>, stream binary")


def run_lengths(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often) of sorted values, each of which counts once or as given."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    if counts is None:
        return values[heads], np.diff(np.append(heads, len(values)))
    return values[heads], np.add.reduceat(counts, heads) if len(heads) else counts[:0]


def merge_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([a[0], b[0]])
    order = np.argsort(values, kind="stable")
    return run_lengths(values[order], np.concatenate([a[1], b[1]])[order])


def bucket_counts(packed: DataFrame) -> DataFrame:
    """bucket, count of all features in ``packed`` streams; a task hands on a run of each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.empty(0, np.uint16), np.empty(0, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                total = merge_runs(total, run_lengths(np.sort(np.frombuffer(stream.as_buffer(), np.uint16))))
        yield pa.RecordBatch.from_arrays([pa.array(total[0].astype(np.int32)), pa.array(total[1].astype(np.int64))], ["bucket", "count"])

    return packed.select("stream").mapInArrow(run, "bucket int, count bigint").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of every bucket, from the counts of both."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(F.broadcast(corpus.withColumnRenamed("count", "s")), "bucket", "left").join(F.broadcast(target.withColumnRenamed("count", "t")), "bucket", "left").na.fill(0, ["s", "t"])  # BUCKETS rows each
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))
    return counts.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))  # one row of sums


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight of every text in ``packed`` streams."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, offsets, stream = (batch.column(c)[i] for c in range(4))
                words, offsets = words.values.to_numpy(), offsets.values.to_numpy()
                sums, some = np.zeros(len(words), np.int64), words > 0
                if some.any():
                    # texts without features are left out, so each sum ends where the next one begins
                    sums[some] = np.add.reduceat(shared.value[np.frombuffer(stream.as_buffer(), np.uint16)], offsets[some])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(words), pa.array(features_of(words)), pa.array(sums)], ["id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: str) -> Column:
    """Floor of 1000 times a Gumbel draw from 32 bits of a hash of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, n_features, weight, score, rank of every row of ``df``; ``rank`` is null of rows that are not drawn.

    ``target`` has a column ``text``; its rows are counted as those of ``df`` are.
    Drawn are ``percent`` of a hundred of the rows with ``least_words`` words, rounded down.
    """
    packed = materialize(streams(df, id_col, text_col), "streams")
    gain = np.zeros(BUCKETS, np.int64)
    for row in gains(bucket_counts(packed), bucket_counts(streams(target.select(F.lit(0).alias("key"), "text"), "key", "text"))).collect():  # BUCKETS rows
        gain[row["bucket"]] = row["gain"]
    scored = materialize(weights(packed, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "weights")
    release(packed)
    fit = scored.where(F.col("n_words") >= least_words).drop("n_words")
    drawn = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(fit, order, "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    rest = scored.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of all documents towards the benchmark, and the ranks of those drawn."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: Codes of features follow bytes by the table of CRC-32, which eight halvings of each byte give.
OP12_SQL = r"""
WITH RECURSIVE halved(b, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM halved WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS codes FROM halved WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, true AS ours, coalesce(text, '') AS text FROM documents
          UNION ALL SELECT -row_number() OVER (), item_id, false, coalesce(text, '') FROM benchmark),
lowered AS (SELECT r, doc_id, ours, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT r, ours, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM lowered WHERE len(w) > 0),
features AS (SELECT r, ours, w1 AS f FROM words WHERE w1 IS NOT NULL
             UNION ALL SELECT r, ours, w1 || ' ' || w2 FROM words WHERE w2 IS NOT NULL
             UNION ALL SELECT r, ours, w1 || ' ' || w2 || ' ' || w3 FROM words WHERE w3 IS NOT NULL),
distinct_features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
coded AS (SELECT f, xor(list_reduce([4294967295] || [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(h) // 2)],
                                    lambda s, b: xor(codes[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 10000 AS bucket
          FROM distinct_features, crc),
counted AS (SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM features JOIN coded USING (f) GROUP BY bucket),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM counted),
gained AS (SELECT bucket, CAST(floor(1000.0 * ln((CAST(t AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM counted, sums),
weighed AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN coded USING (f) JOIN gained USING (bucket) WHERE ours GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
           FROM lowered LEFT JOIN weighed USING (r) WHERE ours),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS place, count(*) OVER () AS fit FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 5 * fit // 100 THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (r)"""
