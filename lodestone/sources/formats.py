"""Text, JSON and Parquet forms of collections, runs, examples and codes.

``read_*`` take paths, which can name many files, and ``write_*`` write them;
``parse_*`` and ``format_*`` do the same with DataFrames of lines, in a column
``value``. Schemas are fixed in code. Pickles are not read: they can run code;
ingest such scores as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import title_text
from . import versions
from .shared import numbered


def parse_collection(lines: DataFrame) -> DataFrame:
    """(id, text): the first tab-separated field and the rest, joined by blanks; lines of one character or less are skipped."""
    parts = F.split("value", "\t", 2)
    rest = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"[\t\r\n]", " ")
    return lines.where(F.length("value") > 1).select(F.get(parts, F.lit(0)).alias("id"), F.trim(rest).alias("text"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return parse_collection(spark.read.text(path))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """(left, right) of lines with exactly two fields; others are an error."""
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.lit("a line has not two fields")).cast("array<string>"))
    return lines.select(checked.alias("p")).select(F.get("p", F.lit(0)).alias("left"), F.get("p", F.lit(1)).alias("right"))


def read_pairs(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Pairs from lines, or from records behind another separator if fields can hold line ends."""
    return parse_pairs(spark.read.text(path, lineSep=separator))


def parse_run(lines: DataFrame) -> DataFrame:
    """(qid, docid, score) of JSON objects of objects."""
    nested = lines.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("qid", "docs"))
    return nested.select("qid", F.explode("docs").alias("docid", "score"))


def read_run(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A run from JSON lines, or from files that are one object each if ``whole``."""
    return parse_run(spark.read.text(path, wholetext=whole))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, score) from Parquet with integer keys, as strings and doubles."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("qid").cast("long").cast("string").alias("qid"), F.col("docid").cast("long").cast("string").alias("docid"), F.col("score").cast("double").alias("score"))


def read_titled(spark: SparkSession, path: str, number_keys: bool = False) -> DataFrame:
    """(idx, key, text) of JSON lines with _id, title and text; idx numbers them by key, as text or number."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    rows = rows.select(F.col("_id").alias("key"), title_text(F.col("title"), F.col("text")).alias("text"))
    place = numbered(rows.select(F.col("key").alias("known")), [F.col("known").cast("long") if number_keys else F.col("known")], "idx")
    return rows.join(place, F.col("key") == F.col("known")).select("idx", "key", "text")


def format_run(run: DataFrame) -> DataFrame:
    """One JSON object of a query and its scores on each line; queries' lists are bounded by their top-k."""
    packed = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("docid").cast("string").alias("docid"), "score"))).alias("docs"))
    value = F.to_json(F.map_from_arrays(F.array(F.col("qid").cast("string")), F.array(F.map_from_entries("docs"))))
    return packed.select(value.alias("value"))


def write_run(run: DataFrame, path: str) -> None:
    """JSON lines, one query each; a second write replaces the first."""
    format_run(run).write.mode("overwrite").text(path)


def parse_examples(lines: DataFrame) -> DataFrame:
    """(qid, pos, docid, score) of JSON lines of parallel arrays."""
    rows = lines.select(F.from_json("value", "qid string, docids array<string>, scores array<double>").alias("x")).select("x.*")
    return rows.select("qid", F.posexplode(F.arrays_zip("docids", "scores")).alias("pos", "z")).select("qid", "pos", F.col("z.docids").alias("docid"), F.col("z.scores").alias("score"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return parse_examples(spark.read.text(path))


def format_examples(examples: DataFrame) -> DataFrame:
    return examples.select(F.to_json(F.struct(F.col("qid").cast("string").alias("qid"), F.transform("docids", lambda x: x.cast("string")).alias("docids"), "scores")).alias("value"))


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON lines, one query each."""
    format_examples(examples).write.mode("overwrite").text(path)


def parse_codes(lines: DataFrame) -> DataFrame:
    """(docid, codes) of JSON objects of arrays."""
    return lines.select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("docid", "codes"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return parse_codes(spark.read.text(path))


def format_codes(codes: DataFrame) -> DataFrame:
    return codes.select(F.to_json(F.map_from_arrays(F.array(F.col("docid").cast("string")), F.array("codes"))).alias("value"))


def write_codes(codes: DataFrame, path: str) -> None:
    """JSON lines, one document's codes each."""
    format_codes(codes).write.mode("overwrite").text(path)


def write_index(postings: DataFrame, path: str, buckets: int = 64, add: bool = False) -> int:
    """Postings by hash bucket of the term, so that a query reads its terms' buckets only.

    They become a version of their own, or are added to the newest one; until it is
    committed, readers have the one before (:mod:`.versions`).
    """
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "term")
    return (versions.append if add else versions.replace)(rows, path, "bucket")


def read_index(spark: SparkSession, path: str, queries: DataFrame | None = None, buckets: int = 64, version: int | None = None) -> DataFrame:
    """The postings, or those in the buckets of the queries' terms; a missing term has no rows."""
    index = versions.read(spark, path, version)
    if queries is not None:
        wanted = [r[0] for r in queries.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]  # at most the number of buckets
        index = index.where(F.col("bucket").isin(wanted))
    return index.drop("bucket")


def write_table(df: DataFrame, path: str) -> None:
    """Runs, embeddings and measurements; a second write replaces the first."""
    df.write.mode("overwrite").parquet(path)
