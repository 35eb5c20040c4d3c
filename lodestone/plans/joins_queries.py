"""Joins and set operations of runs, texts and codes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import dense, prefixes, quantize, ranking, sparse
from .registry import query
from .views import best, rounded


@query("pairs_with_text", "SELECT r.qid, r.docid, length(t.text) AS q_chars, length(c.text) AS d_chars FROM run_a r JOIN topics t USING (qid) JOIN corpus c USING (docid)")
def _(v):
    rows = v.run_a.join(v.topics.withColumnRenamed("text", "q"), "qid").join(v.corpus, "docid")
    return rows.select("qid", "docid", F.length("q").cast("long").alias("q_chars"), F.length("text").cast("long").alias("d_chars"))


@query("pairs_with_both_codes", "SELECT r.qid, r.docid, array_to_string(codes[1:2], '_') AS lex, array_to_string(codes, '_') AS smt FROM run_v r JOIN doc_codes USING (docid)")
def _(v):
    lex = v.codes.select("docid", C.to_string(C.prefix(F.col("codes"), 2)).alias("lex"))
    smt = v.codes.select("docid", C.to_string(F.col("codes")).alias("smt"))
    return v.run_v.join(lex, "docid").join(smt, "docid").select("qid", "docid", "lex", "smt")


@query("sparse_score_join", "SELECT qid, docid, term, round(q.weight * d.weight, 6) AS part FROM topic_weights q JOIN doc_weights d USING (term)")
def _(v):
    rows = v.topic_weights.join(v.index, "term")
    return rows.select("qid", "docid", "term", F.round(F.col("weight") * F.col("value"), 6).alias("part"))


@query("bow_score_join", "SELECT qid, docid, term, round(weight, 6) AS weight FROM topic_weights JOIN bow USING (term)")
def _(v):
    return v.topic_weights.join(v.bow, "term").select("qid", "docid", "term", F.round("weight", 6).alias("weight"))


@query("dense_all_pairs", "SELECT qid, docid, score FROM scores_v")
def _(v):
    return dense.all_pairs(v.query_vectors, v.vectors, digits=True)


@query("smtid_to_docs", "SELECT w.smtid, s.docid FROM (SELECT DISTINCT smtid FROM run_v JOIN smtids USING (docid)) w JOIN smtids s USING (smtid)")
def _(v):
    return v.run_v.join(v.smtids, "docid").select("smtid").distinct().join(v.smtids, "smtid")


@query("run_fusion_inner", "SELECT qid, docid, round(0.4 * a.score + b.score, 6) AS score FROM run_a a JOIN run_b b USING (qid, docid)")
def _(v):
    return rounded(ranking.fuse(v.run_a, v.run_b, 0.4))


@query("rerank_add_lex", "SELECT qid, docid, round(r.score + s.score, 6) AS score FROM run_v r JOIN scores_q s USING (qid, docid)")
def _(v):
    both = quantize.run_scores(v.run_v, v.logits, v.codes)
    return both.select("qid", "docid", F.round(F.col("score") + F.col("other"), 6).alias("score"))


@query("lex_score_lookup", "SELECT q.qid, q.docid, greatest(coalesce(r.score, 0), 0) AS lex FROM qrels_v q LEFT JOIN run_v r USING (qid, docid)")
def _(v):
    rows = v.qrels_v.join(v.run_v, ["qid", "docid"], "left")
    return rows.select("qid", "docid", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("lex"))


@query("qrels_to_smtid", "SELECT qid, smtid, max(rel) AS rel FROM qrels_v JOIN smtids USING (docid) GROUP BY qid, smtid")
def _(v):
    return prefixes.smtid_qrels(v.qrels_v, v.codes, 4)


@query("merge_teacher_left_prior", "SELECT qid, docid, score FROM run_a UNION ALL SELECT qid, docid, score FROM run_b b WHERE NOT EXISTS (SELECT 1 FROM run_a a WHERE a.qid = b.qid AND a.docid = b.docid)")
def _(v):
    return ranking.merge_first_wins(v.run_a, v.run_b, ["qid", "docid"])


@query("qrel_semi_rerank", "SELECT q.qid, q.docid, q.rel, EXISTS (SELECT 1 FROM run_b b WHERE b.qid = q.qid) AS reranked FROM qrels q")
def _(v):
    in_run = v.qrels.join(v.run_b, "qid", "left_semi").withColumn("reranked", F.lit(True))
    return in_run.unionByName(v.qrels.join(v.run_b, "qid", "left_anti").withColumn("reranked", F.lit(False)))


@query("same_prefix_negatives", "SELECT q.qid, a.smtid, b.docid FROM (SELECT qid, docid FROM qrels_v WHERE rel = 3) q JOIN (SELECT docid, array_to_string(codes[1:2], '_') AS smtid FROM doc_codes) a USING (docid) JOIN (SELECT docid, array_to_string(codes[1:2], '_') AS smtid FROM doc_codes) b ON a.smtid = b.smtid GROUP BY ALL")
def _(v):
    groups = prefixes.by_smtid(v.codes, 2)
    relevant = v.qrels_v.where("rel = 3").join(groups, "docid").select("qid", "smtid").distinct()
    return relevant.join(groups, "smtid")


@query("predictions_x_qrels", "SELECT r.qid, r.docid, coalesce(q.rel, 0) AS rel FROM run_v r LEFT JOIN qrels_v q USING (qid, docid)")
def _(v):
    return v.run_v.join(v.qrels_v, ["qid", "docid"], "left").select("qid", "docid", F.coalesce("rel", F.lit(0)).alias("rel"))


@query("prefix_constraint_join", "SELECT s.qid, t.prefix, t.next FROM (SELECT DISTINCT qid, array_to_string(codes[1:2], '_') AS prefix FROM run_v JOIN doc_codes USING (docid)) s JOIN trie t ON t.m = 2 AND t.prefix = s.prefix")
def _(v):
    beams = v.run_v.join(v.stored_codes, "docid").select("qid", C.prefix(F.col("codes"), 2).alias("prefix")).distinct()
    return beams.join(v.tree.where("depth = 2"), "prefix").select("qid", C.to_string(F.col("prefix")).alias("prefix"), "next")


@query("code_to_token_join", "SELECT docid, m, CAST(32000 + m * 8 + code AS INTEGER) AS token FROM code_pos")
def _(v):
    grid = C.token_grid(v.spark, 4, 8).select(F.col("position").alias("m"), "code", C.token_of(F.col("position"), F.col("code"), 8).alias("token"))
    return quantize.code_positions(v.codes).join(F.broadcast(grid), ["m", "code"]).select("docid", F.col("m").cast("long").alias("m"), "token")


@query("codes_to_tokens", "SELECT docid, string_agg(CAST(32000 + m * 8 + code AS VARCHAR), '_' ORDER BY m) AS tokens FROM code_pos GROUP BY docid")
def _(v):
    tokens = F.transform("codes", lambda c, m: C.token_of(m, c, 8))
    return v.codes.select("docid", C.to_string(tokens).alias("tokens"))


@query("adc_lookup_join", "SELECT qid, docid, m, round(part, 6) AS part FROM code_pos JOIN logits USING (m, code)")
def _(v):
    rows = quantize.part_rows(rounded(v.logits, "part"), v.codes)
    return rows.select("qid", "docid", F.col("m").cast("long").alias("m"), "part")


@query("sub_docid_from_run", "SELECT docid, array_to_string(codes, '_') AS codes FROM doc_codes WHERE docid IN (SELECT docid FROM run_v)")
def _(v):
    kept = v.codes.join(v.run_v.select("docid").distinct(), "docid", "left_semi")
    return kept.select("docid", C.to_string(F.col("codes")).alias("codes"))


@query("merge_runs", "SELECT qid, docid, max(score) AS score FROM (SELECT * FROM run_a UNION ALL SELECT * FROM run_a UNION ALL SELECT * FROM run_b) GROUP BY qid, docid")
def _(v):
    return ranking.merge_max([v.run_a, v.run_a, v.run_b], ["qid", "docid"])


TRIPLES = "SELECT qid, smtid, docid, score FROM run_v JOIN smtids USING (docid)"


@query("merge_smtid_runs", "SELECT qid, smtid, docid, max(score) AS score FROM (SELECT * FROM triples UNION ALL SELECT qid, smtid, docid, score * 2 FROM triples) GROUP BY qid, smtid, docid", {"triples": TRIPLES})
def _(v):
    triples = v.run_v.join(v.smtids, "docid").select("qid", "smtid", "docid", "score")
    return ranking.merge_max([triples, triples.withColumn("score", F.col("score") * 2)], ["qid", "smtid", "docid"])


# a bag: what both lists have is there twice
@query("concat_triples", "SELECT qid, smtid, docid, score FROM triples UNION ALL SELECT qid, smtid, docid, CAST(rel AS DOUBLE) AS score FROM qrels_v JOIN smtids USING (docid) UNION ALL SELECT qid, smtid, docid, score FROM triples", {"triples": TRIPLES})
def _(v):
    run = v.run_v.join(v.smtids, "docid").select("qid", "smtid", "docid", "score")
    judged = v.qrels_v.join(v.smtids, "docid").select("qid", "smtid", "docid", F.col("rel").cast("double").alias("score"))
    return ranking.concat([run, judged, run])


@query("merge_inverted_indexes", "SELECT term, count(*) AS n, round(sum(weight), 6) AS total FROM doc_weights GROUP BY term")
def _(v):
    merged = sparse.merge_indexes(v.index.where("docid % 2 = 0"), v.index.where("docid % 2 = 1"))
    return merged.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("dedup_pairs", "SELECT DISTINCT docid FROM run_a")
def _(v):
    return v.run_a.select("docid").dropDuplicates()


@query("run_intersection", "SELECT qid, docid FROM run_a INTERSECT SELECT qid, docid FROM run_b")
def _(v):
    return v.run_a.select("qid", "docid").intersect(v.run_b.select("qid", "docid"))


@query("run_difference", "SELECT qid, docid FROM run_a EXCEPT ALL SELECT qid, docid FROM run_b")
def _(v):
    return v.run_a.select("qid", "docid").exceptAll(v.run_b.select("qid", "docid"))


@query("merge_max_scores", "SELECT qid, smtid, max(score) AS score FROM (SELECT qid, smtid, score FROM triples UNION ALL SELECT qid, smtid, score * 0.5 FROM triples) GROUP BY qid, smtid", {"triples": TRIPLES})
def _(v):
    rows = v.run_v.join(v.smtids, "docid").select("qid", "smtid", "score")
    return ranking.merge_max([rows, rows.withColumn("score", F.col("score") * 0.5)], ["qid", "smtid"])


@query("topk_per_query", best("(SELECT * FROM run_a)", 10))
def _(v):
    return ranking.top_k(v.run_a, 10)


@query("select_topk_partition", best("(SELECT * FROM scores_a WHERE score > 20)", 10))
def _(v):
    return ranking.top_k(rounded(sparse.score(v.topic_weights, v.index, 20.0)), 10)


@query("truncate_run", best("run_v", 5))
def _(v):
    return ranking.top_k(v.run_v, 5)


@query("rank_in_run", "SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM run_a")
def _(v):
    return ranking.with_rank(v.run_a).select("qid", "docid", "rank")


@query("bow_topm_terms", "SELECT docid, term FROM bow")
def _(v):
    return v.bow


@query("doc_top128_info", f"SELECT docid, count(*) AS n, round(sum(weight), 6) AS total FROM ({best('doc_weights', 128, 'docid', 'term', 'weight')}) GROUP BY docid")
def _(v):
    top = ranking.top_k(v.doc_weights, 128, "docid", "weight", "term")
    packed = top.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("x"))
    return packed.select("docid", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s - e.w), 6).alias("total"))


@query("argmax_first_code", "SELECT qid, code FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(part, 6) DESC, code) AS n FROM logits WHERE m = 0) WHERE n = 1")
def _(v):
    best_ = v.logits.where("m = 0").groupBy("qid").agg(F.max(F.struct(F.round("part", 6).alias("s"), (-F.col("code")).alias("c"))).alias("x"))
    return best_.select("qid", (-F.col("x.c")).alias("code"))


@query("most_common_prefixes", "SELECT qid, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, prefix) AS r FROM (SELECT qid, array_to_string(codes[1:2], '_') AS prefix, count(*) AS n FROM run_v JOIN doc_codes USING (docid) GROUP BY ALL)) WHERE r <= 100")
def _(v):
    counts = v.run_v.join(prefixes.by_smtid(v.codes, 2), "docid").groupBy("qid", F.col("smtid").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("n"), "prefix"))).where("r <= 100").drop("r")


# whole code strings of runs of 1,000, of which a query has more than 100
@query("most_common_prefixes_full", "SELECT qid, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, prefix) AS r FROM (SELECT qid, smtid AS prefix, count(*) AS n FROM deep_v JOIN smtids USING (docid) GROUP BY ALL)) WHERE r <= 100")
def _(v):
    counts = v.deep_run.join(v.smtids, "docid").groupBy("qid", F.col("smtid").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("n"), "prefix"))).where("r <= 100").drop("r")
