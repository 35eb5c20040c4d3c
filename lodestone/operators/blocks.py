"""Postings in blocks of documents, in shards that each hold all terms of their documents.

A shard is a range of documents and one group of a table that is bucketed by
shard, so that a task reads whole shards without an exchange. In a shard the
documents are numbered from the one with the largest sum of values down, and a
block is WINDOW of these places. A row has one term's postings in a shard: its
blocks, with the largest and the smallest value that each adds, and the places
and values themselves. The row without a term has the documents by place.

A query's bound for a block is the sum over its terms of weight times the
block's largest value. Blocks are scored from the largest bound down, until the
bound is below the k-th best score so far; the rest cannot hold a better
document and is skipped. As heavy documents share blocks, that comes early.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import broadcast_if_small, release, scratch, written
from .ranking import top_k

#: Documents of a block, and postings of a shard, about.
WINDOW, SHARD = 64, 2_000_000
#: How far below a score a bound must be; scores are compared with six digits.
SLACK = 1e-6

_COLUMNS = "shard int, term string, docids array<{kind}>, windows array<int>, most array<double>, least array<double>, ends array<int>, places array<int>, values array<double>"


def build(postings: DataFrame, path: str | None = None, postings_of_shard: int = SHARD, window: int = WINDOW) -> DataFrame:
    """The index of ``postings`` (term, docid, value), written to ``path`` or the shared folder, as :func:`read` gives it.

    Documents go to shards by ranges of their ids; a task packs its range's
    postings, about ``postings_of_shard``, and one exchange of packed rows puts
    each shard into its bucket.
    """
    spark, kind = postings.sparkSession, postings.schema["docid"].dataType
    postings = written(postings.select("docid", "term", F.col("value").cast("double").alias("value")), "postings")  # counted, sampled and read
    shards = max(1, -(-postings.count() // postings_of_shard))
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _packed(pa.Table.from_batches(held), arrow, window).to_batches(max_chunksize=4096)

    # all postings of a document are in one range
    ranged = postings.repartitionByRange(shards, "docid")
    packed = ranged.withColumn("shard", F.spark_partition_id()).mapInArrow(run, _COLUMNS.format(kind=kind.simpleString()))
    path = path or scratch(spark, "blocks")
    table = f"blocks_{uuid.uuid4().hex}"
    packed.repartition(shards, "shard").write.bucketBy(shards, "shard").sortBy("shard", "term").option("path", path).saveAsTable(table)
    release(postings)
    return spark.table(table)


def read(spark: SparkSession, path: str, shards: int, kind: str = "bigint") -> DataFrame:
    """An index that another session wrote, with its number of buckets and its documents' type."""
    table = f"blocks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({_COLUMNS.format(kind=kind)}) USING parquet CLUSTERED BY (shard) SORTED BY (shard, term) INTO {shards} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _packed(rows: pa.Table, kind: pa.DataType, window: int) -> pa.Table:
    """The rows of one shard."""
    docids, doc = np.unique(rows["docid"].to_numpy(), return_inverse=True)
    terms = rows["term"].combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    term, value = terms.indices.to_numpy(), rows["value"].to_numpy()
    by_sum = np.argsort(-np.bincount(doc, value), kind="stable")
    place = np.empty(len(docids), np.int64)
    place[by_sum] = np.arange(len(docids))
    place = place[doc]
    order = np.lexsort((place, term))
    term, place, value = term[order], place[order], value[order]
    block = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (place[1:] // window != place[:-1] // window)]))
    owner = term[block]  # the term of each block
    n = len(terms.dictionary)
    blocks, rows_of = np.searchsorted(owner, np.arange(n + 1)), np.searchsorted(term, np.arange(n + 1))
    ends = np.append(block[1:], len(term)) - rows_of[owner]
    lists = lambda at, x, t: pa.ListArray.from_arrays(pa.array(np.concatenate([at, at[-1:]]), pa.int32()), pa.array(x, t))
    none = np.zeros(n + 1, np.int32)
    shard = rows["shard"][0].as_py()
    return pa.table(
        {
            "shard": pa.array(np.full(n + 1, shard), pa.int32()),
            "term": pa.concat_arrays([terms.dictionary, pa.nulls(1, terms.dictionary.type)]).cast(pa.string()),
            "docids": pa.ListArray.from_arrays(pa.array(np.append(none, len(docids)), pa.int32()), pa.array(docids[by_sum].tolist(), kind)),
            "windows": lists(blocks, place[block] // window, pa.int32()),
            "most": lists(blocks, np.maximum(np.maximum.reduceat(value, block), 0), pa.float64()),
            "least": lists(blocks, np.minimum(np.minimum.reduceat(value, block), 0), pa.float64()),
            "ends": lists(blocks, ends, pa.int32()),
            "places": lists(rows_of, place, pa.int32()),
            "values": lists(rows_of, value, pa.float64()),
        }
    )


def _flat(rows: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """(the elements of a column of lists, where each row's begin and the last one's end)."""
    lists = pa.chunked_array(rows[name].chunks).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _best_of_shard(rows: pa.Table, k: int, threshold: float, window: int) -> tuple[list, list, list, list[tuple]]:
    """(queries, documents, scores) of the best k of each query, and (query, blocks with a hit, blocks scored)."""
    ids = _flat(rows, "docids")[0].to_numpy(zero_copy_only=False)
    windows, of_row = _flat(rows, "windows")
    windows, (most, least, ends) = windows.to_numpy(), (_flat(rows, c)[0].to_numpy() for c in ("most", "least", "ends"))
    places, starts = _flat(rows, "places")
    places, values = places.to_numpy(), _flat(rows, "values")[0].to_numpy()
    ends = ends + np.repeat(starts[:-1], np.diff(of_row))  # among all postings
    sizes = np.diff(np.concatenate([[0], ends]))
    asked, of_asked = _flat(rows, "asked")
    row, weights = np.repeat(np.arange(rows.num_rows), np.diff(of_asked)), asked.field("weight").to_numpy()
    qids = asked.field("qid").dictionary_encode()
    query = qids.indices.to_numpy()
    by_query = np.argsort(query, kind="stable")
    cuts = np.searchsorted(query[by_query], np.arange(len(qids.dictionary) + 1))
    width, tie = -(-len(ids) // window), np.unique(ids, return_inverse=True)[1]
    out, counts = ([], [], []), []
    for q, qid in enumerate(qids.dictionary.to_pylist()):
        mine = by_query[cuts[q] : cuts[q + 1]]
        n = np.diff(of_row)[row[mine]]
        block, weight = _ranges(of_row[:-1][row[mine]], n), np.repeat(weights[mine], n)
        bounds = np.bincount(windows[block], np.maximum(most[block] * weight, least[block] * weight), width)
        order = np.unique(windows[block])
        order = order[np.argsort(-bounds[order], kind="stable")]
        best, score, kth, scored, step = np.empty(0, np.int64), np.empty(0), -np.inf, 0, -(-k // window)
        while scored < len(order):
            now = order[scored : scored + step]
            now = now[bounds[now] + SLACK >= max(kth, threshold)]
            if not len(now):
                break
            scored, step = scored + len(now), 2 * step
            picked = np.zeros(width, bool)
            picked[now] = True
            of = np.flatnonzero(picked[windows[block]])
            size = sizes[block[of]]
            posting = _ranges(ends[block[of]] - size, size)
            at, back = np.unique(places[posting], return_inverse=True)
            sums = np.bincount(back, values[posting] * np.repeat(weight[of], size), len(at))
            good = np.round(sums, 6) > threshold
            best, score = np.concatenate([best, at[good]]), np.concatenate([score, sums[good]])
            first = np.lexsort((tie[best], -np.round(score, 6)))[:k]
            best, score = best[first], score[first]
            kth = np.round(score[-1], 6) if len(best) == k else -np.inf
        out[0].extend([qid] * len(best))
        out[1].extend(ids[best].tolist())
        out[2].extend(score.tolist())
        counts.append((qid, len(order), scored))
    return *out, counts


def _asked(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The index's rows of the queries' terms with ``asked``, the (qid, weight) of each, and the rows of documents."""
    by_term = queries.where("term IS NOT NULL").groupBy("term").agg(F.collect_list(F.struct("qid", F.col("weight").cast("double").alias("weight"))).alias("asked"))
    by_term = by_term.withColumnRenamed("term", "wanted")
    none = queries.sparkSession.range(1).select(F.lit(None).cast("string").alias("wanted"), F.array().cast(by_term.schema["asked"].dataType).alias("asked"))
    wanted = broadcast_if_small(written(by_term.unionByName(none), "asked"))
    return index.join(wanted, F.col("term").eqNullSafe(F.col("wanted"))).drop("wanted")


def retrieve(queries: DataFrame, index: DataFrame, k: int, threshold: float = 0.0, window: int = WINDOW) -> DataFrame:
    """(qid, docid, score) of each query's best k documents above the threshold; queries are (qid, term, weight).

    The queries' terms are broadcast if they are few, which leaves shards where
    they are; a shard adds up and keeps k rows of each query itself.
    """
    kinds = queries.schema["qid"].dataType, index.schema["docids"].dataType.elementType
    arrow = [to_arrow_type(kind) for kind in kinds]

    def best(rows: pa.Table) -> pa.Table:
        qid, docid, score, _ = _best_of_shard(rows, k, threshold, window)
        return pa.table({"qid": pa.array(qid, arrow[0]), "docid": pa.array(docid, arrow[1]), "score": pa.array(score, pa.float64())})

    found = _asked(queries, index).groupBy("shard").applyInArrow(best, f"qid {kinds[0].simpleString()}, docid {kinds[1].simpleString()}, score double")
    return top_k(found, k)


def skips(queries: DataFrame, index: DataFrame, k: int, threshold: float = 0.0, window: int = WINDOW) -> DataFrame:
    """(shard, qid, blocks, scored): how many blocks of a shard have a term of a query, and how many were scored for its best k."""
    kind = queries.schema["qid"].dataType
    arrow = to_arrow_type(kind)

    def count(rows: pa.Table) -> pa.Table:
        *_, counts = _best_of_shard(rows, k, threshold, window)
        qid, blocks, scored = zip(*counts, strict=True) if counts else ((), (), ())
        shard = pa.array([rows["shard"][0].as_py()] * len(counts), pa.int32())
        return pa.table({"shard": shard, "qid": pa.array(qid, arrow), "blocks": pa.array(blocks, pa.int64()), "scored": pa.array(scored, pa.int64())})

    return _asked(queries, index).groupBy("shard").applyInArrow(count, f"shard int, qid {kind.simpleString()}, blocks bigint, scored bigint")
