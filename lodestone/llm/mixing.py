"""Mixing sources to target weights by repetition rates and hashed draws.

Words are counted for each source before any shuffle of rows, the targets
follow from those counts, and a source's rate is its target over its words.
Each document is emitted floor(rate) times, plus once more if its draw, a hash
of seed, key and text as a number in [0, 1), is below the rate's fraction. The
words taken thus are the target on average, and the same on every run.
Everything is DataFrame work: no Python runs on the executors.

The sources, by code point and null last, weigh 1, 2, 3 and so on in turn. They
share all words by weight; a source stops at 3 times its own words, and what it
leaves is shared again by weight among the others until none is above.

A null text has 0 words, so does an empty one. A null source is a source of its
own. Rows that repeat key and text draw alike. A source without words has the
target 0 and its documents are not emitted. An empty table gives no rows. Other
columns, whatever their names, are returned as they came by :func:`mix_sources`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import numbered
from .common import WORD, broadcast_if_small, fresh, materialize, table, whole

WEIGHTS = (1, 2, 3)
MOST = 3


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def draw(id_col: str, text_col: str, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed, key and text."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(whole(text_col).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target of ``sized``, which has source and size.

    The level, the words left over the weight left, starts without capped
    sources; those that it takes above ``most * source_size`` are capped and
    the level computed again, until it takes none above. Each round is a sum
    over one row of each source, and no task holds all sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sums = numbered(sums, [F.col("source").asc_nulls_last()], "turn")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("turn") % len(WEIGHTS) + 1).cast("int"))
    sums = materialize(sums.withColumns({"w": weight.cast("long"), "cap": F.col("source_size") * most}).drop("turn"), "sources")
    total, weights = sums.agg(F.sum("source_size"), F.sum("w")).first()
    level = float(total) / float(weights) if weights else 0.0
    share = lambda: F.lit(level) * F.col("w")
    while True:
        cap, w = sums.where(share() > F.col("cap")).agg(F.sum("cap"), F.sum("w")).first()
        if w is None or w == weights:
            break
        # what is capped stays capped, as the level only rises
        before, level = level, float(total - cap) / float(weights - w)
        if level == before:
            break
    return sums.select("source", "source_size", F.least(share(), F.col("cap").cast("double")).alias("target"))


def copies(u: Column) -> Column:
    """How often a document is emitted, from source_size, target and its draw."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_targets(rows: DataFrame, rates: DataFrame, source_col: str) -> DataFrame:
    """Sources are broadcast if they are few; else the join of two tables is by their key, which adaptive execution splits."""
    name = fresh(rows, "of_source")
    rates = broadcast_if_small(rates.withColumnRenamed("source", name))
    return rows.join(rates, F.col(source_col).eqNullSafe(F.col(name))).drop(name)


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", most: int = MOST) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with their columns."""
    sized = df.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rates = materialize(targets(sized, most), "rates")
    # one column holds the row, so that no name can clash
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(row, F.col(source_col).alias("source"), draw(id_col, text_col, seed).alias("u"))
    rows = with_targets(rows, rates, "source")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies(F.col("u")).cast("int"))).alias("copy")).select("row.*")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), draw("doc_id", "text", "mix").alias("u")), "sized")
    rows = with_targets(sized, materialize(targets(sized), "rates"), "source")
    return rows.select("doc_id", "size", "source_size", "target", (copies(F.col("u")) * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM sums),
ordered AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
                   coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
            FROM weighed WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(weights - w_before AS DOUBLE) * w > cap AS capped FROM ordered),
levelled AS (SELECT *, CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE)
                       / CAST(nullif(weights - sum(CASE WHEN capped THEN w ELSE 0 END) OVER (), 0) AS DOUBLE) AS level FROM flagged),
aimed AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE least(level * w, CAST(cap AS DOUBLE)) END AS target FROM levelled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST((floor(r.rate) + CASE WHEN s.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END) * s.size AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source"""
