"""Scans and sinks. Files are made from the tables in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import dataset_name, title_text
from ..operators import metrics, ranking, training
from ..sources import formats, versions
from ..sources.shared import scratch as shared_path
from .registry import query


def scratch(v, name: str) -> str:
    """A new folder for a query that writes and reads back."""
    return shared_path(v.spark, name)


def lines(v, df, name: str, separator: str | None = None) -> str:
    """The path of text files with the lines of ``df``."""
    path = scratch(v, name)
    df.write.text(path, lineSep=separator)
    return path


@query("scan_collection", "SELECT CAST(docid AS VARCHAR) AS id, trim(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), ' ') AS text FROM corpus")
def _(v):
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    return formats.read_collection(v.spark, lines(v, v.corpus.select(F.concat_ws("\t", F.col("docid").cast("string"), flat).alias("value")), "collection"))


@query("scan_tsv_pairs", "SELECT CAST(item_id AS VARCHAR) AS \"left\", regexp_replace(text, '[\\t]', ' ', 'g') AS \"right\" FROM benchmark")
def _(v):
    return formats.read_pairs(v.spark, lines(v, v.topics.select(F.concat_ws("\t", F.col("qid").cast("string"), F.regexp_replace("text", "\t", " ")).alias("value")), "pairs", "\x1e"), "\x1e")


@query("scan_run_json", "SELECT CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, score FROM run_v")
def _(v):
    path = scratch(v, "run")
    formats.write_run(v.run_v, path)
    return formats.read_run(v.spark, path)


@query("write_run", "SELECT count(*) AS lines, sum(n) AS entries FROM (SELECT qid, CAST(count(*) AS BIGINT) AS n FROM run_v GROUP BY qid)".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def _(v):
    path = scratch(v, "run")
    formats.write_run(v.run_v, path)
    found = v.spark.read.text(path)
    return found.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size(F.map_values(F.from_json("value", "map<string,map<string,double>>"))[0]).cast("long")).alias("entries"))


EXAMPLES = "SELECT CAST(qid AS VARCHAR) AS qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) - 1 AS INTEGER) AS pos, CAST(docid AS VARCHAR) AS docid, score FROM run_v"


def examples(v):
    ranked = ranking.with_rank(v.run_v).withColumnRenamed("rank", "pos")
    return training.examples(ranked, "qid")


@query("scan_jsonl_examples", EXAMPLES)
def _(v):
    path = scratch(v, "examples")
    formats.write_examples(examples(v), path)
    return formats.read_examples(v.spark, path)


@query("write_jsonl_examples", "SELECT count(DISTINCT qid) AS lines FROM run_v")
def _(v):
    path = scratch(v, "examples")
    formats.write_examples(examples(v), path)
    return v.spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


@query("scan_docid_codes", "SELECT CAST(docid AS VARCHAR) AS docid, array_to_string(codes, '_') AS codes FROM doc_codes")
def _(v):
    path = scratch(v, "codes")
    formats.write_codes(v.codes, path)
    return formats.read_codes(v.spark, path).select("docid", F.array_join(F.col("codes").cast("array<string>"), "_").alias("codes"))


@query("scan_beir_corpus", "SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS idx, page_id AS key, url || ' ' || html AS text FROM pages")
def _(v):
    path = scratch(v, "titled")
    v.table("pages").select(F.col("page_id").cast("string").alias("_id"), F.col("url").alias("title"), F.col("html").alias("text")).write.json(path)
    return formats.read_titled(v.spark, path, number_keys=True).select("idx", F.col("key").cast("long").alias("key"), "text")


@query("title_text_concat", "SELECT page_id, url || ' ' || html AS text FROM pages")
def _(v):
    return v.table("pages").select("page_id", title_text(F.col("url"), F.col("html")).alias("text"))


@query("scan_pickle_scores", "SELECT CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, score FROM run_v")
def _(v):
    path = scratch(v, "scores")
    formats.write_table(v.run_v.select(F.col("qid").cast("int").alias("qid"), "docid", F.col("score").cast("double").alias("score")), path)
    return formats.read_scores(v.spark, path)


@query("write_index", "SELECT term, docid, round(weight, 6) AS value FROM doc_weights WHERE term IN (SELECT term FROM topic_weights)")
def _(v):
    path = scratch(v, "index")
    # two chunks of documents, the second added to the committed first
    formats.write_index(v.index.where("docid % 2 = 0"), path)
    formats.write_index(v.index.where("docid % 2 = 1"), path, add=True)
    found = formats.read_index(v.spark, path, v.topic_weights)
    return found.join(v.topic_weights.select("term").distinct(), "term", "left_semi").select("term", "docid", F.round("value", 6).alias("value"))


@query("load_index", "SELECT w.term, count(d.docid) AS n FROM (SELECT DISTINCT term FROM topic_weights UNION ALL SELECT 'no such term') w LEFT JOIN doc_weights d USING (term) GROUP BY w.term")
def _(v):
    path = scratch(v, "index")
    formats.write_index(v.index, path)
    # a term that no document has is an empty list, not an error
    wanted = v.topic_weights.select("term").distinct().unionByName(v.spark.range(1).select(F.lit("no such term").alias("term")))
    return wanted.join(formats.read_index(v.spark, path, wanted), "term", "left").groupBy("term").agg(F.count("docid").alias("n"))


@query("write_embeddings", "SELECT docid, len(vec) AS dims, round(list_sum(vec::DOUBLE[]), 6) AS total FROM vectors")
def _(v):
    path = scratch(v, "embeddings")
    for r in range(3):  # a chunk for each third of the documents
        versions.append(v.vectors.where(F.pmod("docid", F.lit(3)) == r).select("docid", "vec"), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return versions.read(v.spark, path).select("docid", F.size("vec").cast("long").alias("dims"), F.round(total, 6).alias("total"))


@query("write_perf", f"SELECT 'vectors' AS dataset, 'rr' AS metric, round(avg(rr), 6) AS value FROM (SELECT q.qid, coalesce(1.0 / min(r.n), 0) AS rr FROM (SELECT DISTINCT qid FROM qrels_v) q JOIN (SELECT DISTINCT qid FROM run_v) u USING (qid) LEFT JOIN (SELECT r.qid, r.n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS n FROM run_v) r JOIN qrels_v USING (qid, docid) WHERE n <= 10) r ON r.qid = q.qid GROUP BY q.qid)")
def _(v):
    path = scratch(v, "perf")
    value = metrics.reciprocal_ranks(v.run_v, v.groups_v, 10).agg(F.round(F.avg("rr"), 6).alias("value"))
    formats.write_table(value.select(F.lit("vectors").alias("dataset"), F.lit("rr").alias("metric"), "value"), path)
    return v.spark.read.parquet(path)


_PATHS = ["/d/TREC_DL_2019/msmarco/qrel.json", "/d/trec2020/msmarco", "/d/msmarco/train_queries/raw", "/d/msmarco/dev", "/d/MSMarco-v2/dev_1", "/d/MSMarco-v2/dev_2/x", "/d/toy", "/d/nq-320k/dev", "/d/beir"]
_LABELS = ["TREC_DL_2019", "TREC_DL_2020", "MSMARCO_TRAIN", "MSMARCO", "MSMARCO_v2_dev1", "MSMARCO_v2_dev2", "TOY", "NQ_320K", "other_dataset"]


@query("dataset_name", "SELECT page_id, p || '#' || url AS path, dataset FROM pages JOIN (VALUES " + ", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(zip(_PATHS, _LABELS, strict=True))) + ") t(i, p, dataset) ON page_id % 9 = i")
def _(v):
    # pages as if they lay in the folders of data sets
    path = F.concat(F.get(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % 9).cast("int")), F.lit("#"), F.col("url"))
    return v.table("pages").select("page_id", path.alias("path")).withColumn("dataset", dataset_name(F.col("path")))


@query("sparse_stats_per_shard", "SELECT round(avg(l0), 6) AS l0 FROM (SELECT avg(n) AS l0 FROM (SELECT docid, docid % 4 AS shard, count(*) AS n FROM doc_weights GROUP BY docid) GROUP BY shard)")
def _(v):
    # the unweighted mean of shards' means
    shards = v.doc_weights.groupBy("docid").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("docid") % 4).agg(F.avg("n").alias("l0"))
    return shards.agg(F.round(F.avg("l0"), 6).alias("l0"))
