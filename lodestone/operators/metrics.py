"""Ranking metrics; only queries with both a run and judgments count.

Judgments of at least 1 are relevant. Ranks break ties by the smaller docid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import broadcast_if_small, written
from .ranking import with_rank


@dataclass
class ByGroup:
    """Judgments of each query on all documents of its group but itself, which are never listed.

    ``docs`` has docid, group and rel, ``queries`` qid and group; ids are unique. All
    functions here that take judgments as rows (qid, docid, rel) take these too. What is
    shuffled grows with documents and queries, not with their pairs.
    """

    docs: DataFrame
    queries: DataFrame
    _known: dict[int, DataFrame] = field(default_factory=dict, repr=False)

    def _groups(self, k: int) -> DataFrame:
        """(group, all, good, best): counts, and the best ``k`` or more as (place, docid, rel); computed once."""
        deep = [depth for depth in self._known if depth >= k]
        if not deep:
            place = F.row_number().over(W.partitionBy("group").orderBy(F.desc("rel"), "docid"))
            best = self.docs.withColumn("place", place).where(F.col("place") <= k)
            best = best.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "docid", "rel"))).alias("best"))
            counts = self.docs.groupBy("group").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("rel") >= 1).alias("good"))
            self._known[k] = written(counts.join(best, "group"), "groups")
            deep = [k]
        return self._known[min(deep)]

    def asked(self, k: int = 0) -> DataFrame:
        """(qid, relevant, ideal) of the queries with judgments; ``ideal`` is the best order's first ``k`` as (rank, rel)."""
        groups = self._groups(k + 1)  # one of them may be the query
        own = self.docs.select(F.col("docid").alias("qid"), "group", F.lit(1).alias("own"), (F.col("rel") >= 1).cast("int").alias("own_good"))
        rows = self.queries.join(own, ["qid", "group"], "left").join(broadcast_if_small(groups, 200_000 // (k + 1)), "group")
        rows = rows.where(F.col("all") > F.coalesce("own", F.lit(0)))
        others = F.slice(F.filter("best", lambda x: x.docid != F.col("qid")), 1, k)
        ideal = F.transform(others, lambda x, i: F.struct((i + 1).alias("rank"), x.rel.alias("rel")))
        return rows.select("qid", (F.col("good") - F.coalesce("own_good", F.lit(0))).alias("relevant"), ideal.alias("ideal"))

    def of(self, ranked: DataFrame) -> DataFrame:
        """``ranked`` (qid, docid, ...) with ``rel``, null where the query does not judge the document."""
        rows = ranked.join(self.queries.select("qid", F.col("group").alias("asks")), "qid").join(self.docs, "docid", "left")
        rel = F.when((F.col("group") == F.col("asks")) & (F.col("docid") != F.col("qid")), F.col("rel"))
        return rows.select(*ranked.columns, rel.alias("rel"))


def judged(run: DataFrame, qrels: DataFrame | ByGroup, k: int) -> DataFrame:
    """(qid, docid, rank, rel) of judged queries' first ``k``; unjudged documents have rel 0.

    The ranked rows go to the judgments, if they are few, and not all judgments to them.
    """
    if isinstance(qrels, ByGroup):
        top = with_rank(run).where(F.col("rank") <= k).join(qrels.asked(k).select("qid"), "qid", "left_semi")
        return qrels.of(top).select("qid", "docid", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    ranked = written(with_rank(run).where(F.col("rank") <= k), "ranked")
    hits = qrels.join(broadcast_if_small(ranked.select("qid", "docid")), ["qid", "docid"])
    ranked = ranked.join(qrels.select("qid").distinct(), "qid", "left_semi")
    return ranked.join(hits, ["qid", "docid"], "left").select("qid", "docid", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def totals(qrels: DataFrame | ByGroup) -> DataFrame:
    if isinstance(qrels, ByGroup):
        return qrels.asked().select("qid", "relevant")
    return qrels.where("rel >= 1").groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))


def ideal(qrels: DataFrame | ByGroup, k: int) -> DataFrame:
    """(qid, ideal): the discounted gain of the best order."""
    if isinstance(qrels, ByGroup):
        gain = F.aggregate("ideal", F.lit(0.0), lambda s, x: s + x.rel / F.log2(x.rank + 1))
        return qrels.asked(k).select("qid", gain.alias("ideal"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "docid"))
    return qrels.withColumn("r", rank).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("ideal"))


def reciprocal_ranks(run: DataFrame, qrels: DataFrame | ByGroup, k: int) -> DataFrame:
    """(qid, rr): of the first relevant document among k, else 0."""
    rows = judged(run, qrels, k).groupBy("qid").agg(F.min(F.when((F.col("rel") >= 1) & (F.col("rank") <= k), F.col("rank"))).alias("first"))
    return rows.select("qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def per_query(run: DataFrame, qrels: DataFrame | ByGroup, k: int) -> DataFrame:
    """(qid, rr, recall, precision, ndcg, ap, r_cap) at k, from one pass over the run."""
    hit = (F.col("rel") >= 1) & (F.col("rank") <= k)
    rows = judged(run, qrels, k)
    so_far = F.sum(hit.cast("int")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"hit": hit, "so_far": so_far})
    sums = rows.groupBy("qid").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.col("hit").cast("int")).alias("hits"),
        F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
        F.sum(F.when(F.col("hit"), F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    both = sums.join(totals(qrels), "qid", "left").join(ideal(qrels, k), "qid", "left")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = F.coalesce("relevant", F.lit(0))
    return both.select(
        "qid",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        share(F.col("hits"), n).alias("recall"),
        (F.col("hits") / k).alias("precision"),
        share(F.col("gain"), F.coalesce("ideal", F.lit(0.0))).alias("ndcg"),
        share(F.col("precisions"), n).alias("ap"),
        share(F.col("hits"), F.least(n, F.lit(k))).alias("r_cap"),
    )


def evaluate(run: DataFrame, qrels: DataFrame | ByGroup, cuts: list[int]) -> DataFrame:
    """(k, metric, value): the mean of every metric at every cut, zeros included.

    A query's ranks are computed once, to the deepest cut. Its relevant ranks, its
    gains and its ideal gains are arrays by rank, of as many elements at most, and
    each metric at each cut is a sum over the elements within the cut.
    """
    names, deepest = ["rr", "recall", "precision", "ndcg", "ap", "r_cap"], max(cuts)
    top = with_rank(run).where(F.col("rank") <= deepest)
    if isinstance(qrels, ByGroup):
        asked = qrels.asked(deepest)
        hit = qrels.of(top).where("rel <> 0")
    else:
        asked = qrels.groupBy("qid").agg(F.count(F.when(F.col("rel") >= 1, 1)).alias("relevant"))
        place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "docid"))
        best = qrels.withColumn("rank", place).where(F.col("rank") <= deepest).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("ideal"))
        asked = asked.join(best, "qid", "left")
        hit = top.join(qrels.where("rel <> 0"), ["qid", "docid"])
    # queries without a row of the run do not count
    found = top.select("qid").distinct().join(asked, "qid")
    ranks = hit.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("rel") >= 1, F.col("rank")))).alias("hits"), F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("gains"))
    rows = found.join(ranks, "qid", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("hits", "gains", "ideal")})
    rows = rows.withColumn("precisions", F.transform("hits", lambda x, i: F.struct(x.alias("rank"), ((i + 1) / x).alias("share"))))
    add = lambda pairs, value: F.aggregate(pairs, F.lit(0.0), lambda s, x: s + value(x))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    discounted = lambda x: x.rel / F.log2(x.rank + 1)

    def at(k: int) -> Column:
        within = lambda pairs: F.filter(pairs, lambda x: x.rank <= k)
        hits, n = F.size(F.filter("hits", lambda x: x <= k)), F.col("relevant")
        first = F.get("hits", F.lit(0))
        values = [
            F.when(first <= k, 1.0 / first).otherwise(0.0),
            share(hits, n),
            hits / k,
            share(add(within("gains"), discounted), add(within("ideal"), discounted)),
            share(add(within("precisions"), lambda x: x.share), n),
            share(hits, F.least(n, F.lit(k))),
        ]
        return F.struct(F.lit(k).alias("k"), *(v.alias(name) for name, v in zip(names, values, strict=True)))

    each = rows.select(F.explode(F.array(*map(at, cuts))).alias("x")).select("x.*")
    means = each.groupBy("k").agg(*(F.avg(n).alias(n) for n in names))
    none = run.sparkSession.createDataFrame([(k,) for k in cuts], "k int").join(means, "k", "left")  # a cut without queries is 0
    stacked = F.expr("stack(6, " + ", ".join(f"'{n}', coalesce({n}, 0.0D)" for n in names) + ") AS (metric, value)")
    return none.select("k", stacked)


def goes_with(metric: Column, graded: Column) -> Column:
    """Whether :func:`check_metric` would accept the metric."""
    return graded == F.startswith(metric, F.lit("ndcg"))


def check_metric(metric: str, graded: bool) -> None:
    """Graded judgments are for ndcg, binary ones for all other metrics."""
    if graded != metric.startswith("ndcg"):
        raise ValueError(f"{metric} does not go with {'graded' if graded else 'binary'} judgments")
