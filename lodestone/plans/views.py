"""The test tables as retrieval tables, for Spark and as SQL.

Documents are the corpus and benchmark items its topics. Every fiftieth vector is
a query against all vectors, and labels judge them; the first vectors are the
codewords of a given codebook.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scores import tokens
from ..operators import beam, dense, metrics, prefixes, quantize, ranking, sparse
from ..sources.shared import broadcast_if_small, written

K, TERMS, LEVELS, SIZE, BEAMS = 50, 16, 4, 8, 4
#: Limits as deep as the survey's, for the queries named ``_full``.
DEEP_K, DEEP_TEACHER, LONG = 1000, 250, 8


class Views:
    """Lazy tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def corpus(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("docid"), "text")

    @cached_property
    def topics(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def doc_weights(self) -> DataFrame:
        return sparse.term_weights(self.corpus, "docid")

    @cached_property
    def topic_weights(self) -> DataFrame:
        return sparse.term_weights(self.topics, "qid")

    @cached_property
    def index(self) -> DataFrame:
        return sparse.postings(self.doc_weights)

    @cached_property
    def run_a(self) -> DataFrame:
        return rounded(sparse.retrieve_texts(self.topic_weights, self.corpus, K))

    @cached_property
    def bow(self) -> DataFrame:
        return sparse.term_set(self.doc_weights, TERMS)

    @cached_property
    def run_b(self) -> DataFrame:
        return rounded(ranking.top_k(sparse.score_sets(self.topic_weights, self.bow), K))

    @cached_property
    def qrels(self) -> DataFrame:
        pairs = sparse.containing(self.corpus, self.topics)
        return pairs.select("qid", "docid", (1 + F.col("docid") % 3).cast("int").alias("rel"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("docid"), F.col("embedding").alias("vec"), "label")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self.vectors.where("docid % 50 = 0").select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"))

    @cached_property
    def run_v(self) -> DataFrame:
        return dense.retrieve_blocked(self.query_vectors, self.vectors, K, but_self=True)

    @cached_property
    def qrels_v(self) -> DataFrame:
        asked = broadcast_if_small(self.query_vectors.select("qid", "qlabel"))
        pairs = dense.dealt(self.vectors.select("docid", "label")).join(asked, F.col("label") == F.col("qlabel")).where("qid != docid")
        return pairs.select("qid", "docid", (1 + F.col("docid") % 3).cast("int").alias("rel"))

    @cached_property
    def groups_v(self) -> metrics.ByGroup:
        """``qrels_v`` without its pairs, for metrics."""
        docs = self.vectors.where("docid IS NOT NULL").select("docid", F.col("label").alias("group"), (1 + F.col("docid") % 3).cast("int").alias("rel"))
        return metrics.ByGroup(docs, self.query_vectors.select("qid", F.col("qlabel").alias("group")))

    @cached_property
    def codebook(self) -> DataFrame:
        return self.given_codebook(LEVELS)

    def given_codebook(self, levels: int) -> DataFrame:
        rows = self.vectors.where(F.col("docid") < levels * SIZE).withColumn("m", F.floor(F.col("docid") / SIZE).cast("int"))
        scaled = F.transform("vec", lambda x: x.cast("double") * F.pow(F.lit(0.5), F.col("m")))
        return rows.select("m", (F.col("docid") % SIZE).cast("int").alias("code"), scaled.alias("vec"))

    @cached_property
    def codes(self) -> DataFrame:
        return quantize.encode(self.vectors, self.codebook, LEVELS)

    @cached_property
    def stored_codes(self) -> DataFrame:
        """The codes from files, for plans that read them often."""
        return written(self.codes, "codes")

    @cached_property
    def stored_run(self) -> DataFrame:
        return written(self.run_v, "run")

    @cached_property
    def tree(self) -> DataFrame:
        """The prefix tree of all codes, by depth and bucketed by prefix."""
        return prefixes.store(self.codes, buckets=8)

    @cached_property
    def long_codebook(self) -> DataFrame:
        return self.given_codebook(LONG)

    @cached_property
    def long_codes(self) -> DataFrame:
        return written(quantize.encode(self.vectors, self.long_codebook, LONG), "codes")

    @cached_property
    def deep_run(self) -> DataFrame:
        return dense.retrieve_blocked(self.query_vectors, self.vectors, DEEP_K, but_self=True)

    @cached_property
    def deep_teacher(self) -> DataFrame:
        """The teacher's scores of each topic's best 250 documents."""
        run = rounded(sparse.retrieve_texts(self.topic_weights, self.corpus, DEEP_TEACHER))
        return jaccard(run.select("qid", "docid"), self.topics, self.corpus)

    @cached_property
    def logits(self) -> DataFrame:
        return quantize.code_scores(self.query_vectors, self.codebook)

    @cached_property
    def smtids(self) -> DataFrame:
        return prefixes.by_smtid(self.codes, LEVELS)

    @cached_property
    def lexical(self) -> DataFrame:
        """Candidates of the vector queries with a lexical score."""
        return self.run_v

    @cached_property
    def teacher(self) -> DataFrame:
        """Jaccard of the distinct tokens of topic and document, for each topic's best 20."""
        return jaccard(self.candidates, self.topics, self.corpus)

    @cached_property
    def candidates(self) -> DataFrame:
        """The best 20 documents of each topic."""
        return ranking.top_k(self.run_a, 20).select("qid", "docid")


def jaccard(pairs: DataFrame, topics: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, docid, score) of the pairs' distinct tokens; only their texts are read into tokens."""
    queries = topics.select("qid", F.array_distinct(tokens(F.col("text"))).alias("a"))
    rows = pairs.join(queries, "qid").join(corpus, "docid").select("qid", "docid", "a", F.array_distinct(tokens(F.col("text"))).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return rows.select("qid", "docid", F.round(both / (F.size("a") + F.size("b") - both), 6).alias("score"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


def text_tokens(view: DataFrame, id_col: str) -> DataFrame:
    return view.select(id_col, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _weights(view: str, key: str) -> str:
    return f"SELECT {key}, term, ln(1 + count(*)) AS weight FROM (SELECT {key}, unnest({_TOKENS}) AS term FROM {view}) GROUP BY {key}, term"


def best(source: str, k: int, group: str = "qid", tie: str = "docid", score: str = "score") -> str:
    return f"SELECT * EXCLUDE (r_) FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY round({score}, 6) DESC, {tie}) AS r_ FROM {source}) WHERE r_ <= {k}"


#: Views by name; a statement gets those that it names, and what they name.
SQL: dict[str, str] = {
    "corpus": "SELECT doc_id AS docid, text FROM documents",
    "topics": "SELECT item_id AS qid, text FROM benchmark",
    "doc_weights": _weights("corpus", "docid"),
    "topic_weights": _weights("topics", "qid"),
    "scores_a": "SELECT qid, docid, round(sum(q.weight * d.weight), 6) AS score FROM topic_weights q JOIN doc_weights d USING (term) GROUP BY qid, docid HAVING round(sum(q.weight * d.weight), 6) > 0",
    "run_a": best("scores_a", K),
    "bow": f"SELECT docid, term FROM ({best('doc_weights', TERMS, 'docid', 'term', 'weight')})",
    "scores_b": "SELECT qid, docid, round(sum(weight), 6) AS score FROM topic_weights JOIN bow USING (term) GROUP BY qid, docid",
    "run_b": best("scores_b", K),
    "qrels": "SELECT qid, docid, CAST(1 + docid % 3 AS INTEGER) AS rel FROM corpus c, topics t WHERE contains(c.text, t.text)",
    "vectors": "SELECT vec_id AS docid, embedding AS vec, label FROM embeddings",
    "query_vectors": "SELECT docid AS qid, vec AS qvec, label AS qlabel FROM vectors WHERE docid % 50 = 0",
    "scores_v": "SELECT qid, docid, round(list_inner_product(qvec::DOUBLE[], vec::DOUBLE[]), 6) AS score FROM query_vectors, vectors",
    "run_v": best("(SELECT * FROM scores_v WHERE qid <> docid)", K),
    "qrels_v": "SELECT qid, docid, CAST(1 + docid % 3 AS INTEGER) AS rel FROM vectors JOIN query_vectors ON label = qlabel WHERE qid <> docid",
    "teacher_pairs": f"SELECT qid, docid FROM ({best('run_a', 20)})",
    "teacher": """SELECT p.qid, p.docid, round(coalesce(i.n, 0) / (q.n + d.n - coalesce(i.n, 0)), 6) AS score FROM teacher_pairs p
        JOIN (SELECT qid, count(*) AS n FROM topic_weights GROUP BY qid) q ON q.qid = p.qid JOIN (SELECT docid, count(*) AS n FROM doc_weights GROUP BY docid) d ON d.docid = p.docid
        LEFT JOIN (SELECT p.qid, p.docid, count(*) AS n FROM teacher_pairs p JOIN topic_weights t ON t.qid = p.qid JOIN doc_weights w ON w.docid = p.docid AND w.term = t.term GROUP BY p.qid, p.docid) i ON i.qid = p.qid AND i.docid = p.docid""",
}
SQL |= {
    "deep_v": best("(SELECT * FROM scores_v WHERE qid <> docid)", DEEP_K),
    "deep_pairs": f"SELECT qid, docid FROM ({best('scores_a', DEEP_TEACHER)})",
    "deep_teacher": SQL["teacher"].replace("teacher_pairs", "deep_pairs"),
    "bow_64": f"SELECT docid, term FROM ({best('doc_weights', 64, 'docid', 'term', 'weight')})",
}


def _of_codes(levels: int, tag: str) -> dict[str, str]:
    """Views of codes with so many levels; ``tag`` ends their names."""
    views = {
        f"codebook{tag}": f"SELECT CAST(docid // {SIZE} AS INTEGER) AS m, CAST(docid % {SIZE} AS INTEGER) AS code, list_transform(vec, lambda x: x::DOUBLE * pow(0.5, docid // {SIZE})) AS vec FROM vectors WHERE docid < {levels * SIZE}",
        f"level_0{tag}": "SELECT docid, vec::DOUBLE[] AS rest, []::INTEGER[] AS codes FROM vectors",
        f"logits{tag}": f"SELECT qid, m, code, list_inner_product(qvec::DOUBLE[], vec) AS part FROM query_vectors, codebook{tag}",
    }
    for m in range(levels):
        views[f"near_{m}{tag}"] = f"SELECT docid, rest, codes, code, vec, row_number() OVER (PARTITION BY docid ORDER BY round(list_sum(list_transform(list_zip(rest, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), code) AS n FROM level_{m}{tag}, codebook{tag} WHERE m = {m}"
        views[f"level_{m + 1}{tag}"] = f"SELECT docid, list_transform(list_zip(rest, vec), lambda z: z[1] - z[2]) AS rest, list_append(codes, code) AS codes FROM near_{m}{tag} WHERE n = 1"
    return views | {
        f"doc_codes{tag}": f"SELECT docid, codes FROM level_{levels}{tag}",
        f"smtids{tag}": f"SELECT array_to_string(codes, '_') AS smtid, docid FROM doc_codes{tag}",
        f"code_pos{tag}": f"SELECT docid, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS m FROM doc_codes{tag}",
        f"code_edges{tag}": f"SELECT docid, array_to_string(codes[1:m], '_') AS prefix, m, code AS next FROM code_pos{tag} JOIN doc_codes{tag} USING (docid)",
        f"trie{tag}": f"SELECT DISTINCT prefix, m, next FROM code_edges{tag}",
        f"pooled{tag}": f"SELECT qid, prefix, m, next, max(score) AS mx, min(score) AS mn, avg(score) AS av FROM run_v JOIN code_edges{tag} USING (docid) GROUP BY ALL",
        f"scores_q{tag}": f"SELECT qid, docid, round(sum(part), 6) AS score FROM code_pos{tag} JOIN logits{tag} USING (m, code) GROUP BY qid, docid",
    }


SQL |= _of_codes(LEVELS, "") | _of_codes(LONG, "_long")


def with_views(statement: str, extra: dict[str, str] | None = None) -> str:
    """The statement behind the views that it needs."""
    known = SQL | (extra or {})
    needed: dict[str, None] = {}

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in known and name not in needed and known[name] is not text:
                add(known[name])
                needed.setdefault(name)

    add(statement)
    # each view is computed once, however often others name it
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed)
    return f"WITH {ctes}\n{statement}" if ctes else statement


def beam_sql(kind: str, beams: int = BEAMS, length: int = LEVELS, tag: str = "", of: str = "") -> dict[str, str]:
    """Views of a search, the last of them ``found``; ``tag`` ends all their names, ``of`` those of the codes.

    ``kind`` is constrained, condition, incorporate or guided by a pooled score.
    """
    views = {f"beam_0{tag}": "SELECT qid, '' AS prefix, 0.0::DOUBLE AS score FROM query_vectors"}
    how = {"guided_max": "mx", "guided_min": "mn", "guided_mean": "av"}.get(kind)
    for m in range(length):
        trie = f"beam_{m}{tag} b JOIN trie{of} t ON t.m = {m} AND t.prefix = b.prefix"
        source, extra = f"beam_{m}{tag} b JOIN pooled{of} t ON t.qid = b.qid AND t.m = {m} AND t.prefix = b.prefix", f" + t.{how}" if how else ""
        if kind == "constrained":
            source = trie
        elif kind == "incorporate":
            source = f"{trie} LEFT JOIN pooled{of} p ON p.qid = b.qid AND p.m = {m} AND p.prefix = b.prefix AND p.next = t.next"
            extra = " + greatest(coalesce(p.mx, 0), 0)"
        step = "CASE WHEN b.prefix = '' THEN '' ELSE b.prefix || '_' END || t.next"
        rank = f"row_number() OVER (PARTITION BY b.qid ORDER BY round(b.score + l.part{extra}, 6) DESC, {step})"
        views[f"step_{m}{tag}"] = f"SELECT b.qid, {step} AS prefix, b.score + l.part AS score, {rank} AS r FROM {source} JOIN logits{of} l ON l.qid = b.qid AND l.m = {m} AND l.code = t.next"
        views[f"beam_{m + 1}{tag}"] = f"SELECT qid, prefix, score FROM step_{m}{tag} WHERE r <= {beams}"
    views[f"found{tag}"] = f"SELECT qid, prefix AS smtid, score FROM beam_{length}{tag}"
    return views


def beams_of(v: Views, kind: str, beams: int | None = BEAMS, length: int = LEVELS) -> DataFrame:
    """(qid, codes, score) of the same searches."""
    if kind in ("constrained", "incorporate"):
        # depths below ``length`` of the tree of whole codes are the tree of the shorter ones
        pooled = {} if kind == "constrained" else {"lexical": prefixes.pooled(v.lexical, shorter(v, length)), "floor": True}
        return beam.search(v.query_vectors, v.tree, v.logits, length, beams, **pooled)
    codes, how = shorter(v, length), None if kind == "condition" else kind.split("_")[1]
    trie = prefixes.query_edges(v.lexical, codes)
    return beam.search(v.query_vectors, trie, v.logits, length, beams, how and prefixes.pooled(v.lexical, codes, how))


def shorter(v: Views, length: int) -> DataFrame:
    return v.codes.select("docid", C.prefix(F.col("codes"), length).alias("codes"))
