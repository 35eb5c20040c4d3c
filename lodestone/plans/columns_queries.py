"""Projections, filters and column functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import scores as S
from ..operators import prefixes, ranking, sparse
from ..sources.shared import numbered
from .registry import query
from .views import rounded, text_tokens


@query("score_threshold", "SELECT qid, docid, score FROM scores_a WHERE score > 30")
def _(v):
    return rounded(sparse.score(v.topic_weights, v.index, 30.0))


@query("filter_graded_rel", "SELECT qid, docid, rel FROM qrels_v WHERE rel >= 2")
def _(v):
    return v.qrels_v.where("rel >= 2")


@query("filter_group_size_between", "SELECT qid, count(*) AS n FROM qrels_v GROUP BY qid HAVING count(*) BETWEEN 20 AND 60 ORDER BY qid LIMIT 20")
def _(v):
    return v.qrels_v.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(20, 60)).orderBy("qid").limit(20)


@query("drop_self_match", "SELECT qid, docid, score FROM scores_v WHERE qid <> docid")
def _(v):
    from ..operators import dense

    return ranking.drop_self_match(dense.all_pairs(v.query_vectors, v.vectors, digits=True))


@query("drop_empty_smtid", "SELECT count(*) FILTER (n > 0) AS kept, count(*) FILTER (n = 0) AS dropped FROM (SELECT g.smtid, count(s.docid) AS n FROM (SELECT i // 512 || '_' || i // 64 % 8 || '_' || i // 8 % 8 || '_' || i % 8 AS smtid FROM range(4096) x(i)) g LEFT JOIN smtids s USING (smtid) GROUP BY g.smtid)")
def _(v):
    # every sequence of four codes
    digits = [(F.floor(F.col("id") / 8**k) % 8).cast("int") for k in (3, 2, 1, 0)]
    grid = v.spark.range(8**4).select(C.to_string(F.array(*digits)).alias("smtid"))
    n = grid.join(v.smtids, "smtid", "left").groupBy("smtid").agg(F.count("docid").alias("n"))
    return n.agg(F.count_if(F.col("n") > 0).alias("kept"), F.count_if(F.col("n") == 0).alias("dropped"))


@query("exclude_positive", "SELECT r.qid, q.docid AS rel_docid, r.docid FROM run_v r JOIN qrels_v q USING (qid) WHERE r.docid <> q.docid AND q.rel = 3")
def _(v):
    positive = v.qrels_v.where("rel = 3").select("qid", F.col("docid").alias("rel_docid"))
    return v.run_v.join(positive, "qid").where("docid != rel_docid").select("qid", "rel_docid", "docid")


@query("project_codes_prefix", "SELECT docid, array_to_string(codes[1:2], '_') AS prefix FROM doc_codes")
def _(v):
    return v.codes.select("docid", C.to_string(C.prefix(F.col("codes"), 2)).alias("prefix"))


@query("validate_codes", "SELECT docid, len(codes) IN (4, 8, 16, 32) AND codes[1] <> -1 AND list_min(codes) >= 1 AS valid FROM doc_codes")
def _(v):
    return v.codes.select("docid", C.valid_codes(F.col("codes"), least=1).alias("valid"))


@query("shard_filter", "SELECT docid FROM (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS n FROM vectors) WHERE n % 8 = 3")
def _(v):
    return numbered(v.vectors.select("docid"), [F.col("docid")], "n").where("n % 8 = 3").select("docid")


@query("rekey_ids", "SELECT n AS idx, docid AS key FROM (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS n FROM vectors) WHERE n IN (SELECT docid FROM run_v)")
def _(v):
    keys = numbered(v.vectors.select(F.col("docid").alias("key")), [F.col("key")], "idx")
    return v.run_v.select(F.col("docid").alias("idx")).distinct().join(keys, "idx")


LOGITS = "SELECT docid AS id, term, CASE WHEN pos % 7 = 0 THEN 0 ELSE 1 END AS mask, length(term) - 4.0 AS logit FROM (SELECT docid, unnest(x) AS term, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT docid, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS x FROM corpus))"


def token_logits(v):
    """Stand-ins for logits of tokens: by length, with every seventh position masked."""
    rows = text_tokens(v.corpus, "docid")
    return rows.select(F.col("docid").alias("id"), "term", F.when(F.col("pos") % 7 == 0, 0).otherwise(1).alias("mask"), (F.length("term") - 4.0).alias("logit"))


@query("attention_mask", "SELECT id, count(*) AS n FROM token_logits WHERE mask = 1 GROUP BY id", {"token_logits": LOGITS})
def _(v):
    return token_logits(v).where("mask = 1").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


POOLED = "SELECT id, term, max(CASE WHEN mask = 1 THEN ln(1 + greatest(logit, 0)) ELSE 0 END) AS weight FROM token_logits GROUP BY id, term"


# pooled weights of short and of masked terms are 0
@query("filter_nonzero", "SELECT term, count(*) AS n FROM pooled_weights WHERE weight <> 0 GROUP BY term", {"token_logits": LOGITS, "pooled_weights": POOLED})
def _(v):
    return sparse.postings(sparse.pool(token_logits(v)), "id").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("splade_pool", "SELECT id, term, round(max(CASE WHEN mask = 1 THEN ln(1 + greatest(logit, 0)) ELSE 0 END), 6) AS weight FROM token_logits GROUP BY id, term", {"token_logits": LOGITS})
def _(v):
    return rounded(sparse.pool(token_logits(v)), "weight")


@query("strsmtid", "SELECT docid, array_to_string(codes, '_') AS smtid FROM doc_codes")
def _(v):
    return v.codes.select("docid", C.to_string(F.concat(F.array(F.lit(-1)), F.col("codes")), skip=1).alias("smtid"))


@query("parse_strsmtid", "SELECT docid, m, code FROM code_pos")
def _(v):
    parsed = v.smtids.select("docid", F.posexplode(C.from_string(F.col("smtid"))).alias("m", "code"))
    return parsed.select("docid", F.col("m").cast("long").alias("m"), "code")


@query("append_last_code", "SELECT DISTINCT array_to_string(codes[1:3], '_') || '_' || n AS smtid FROM doc_codes, range(8) r(n)")
def _(v):
    heads = v.codes.select(C.prefix(F.col("codes"), 3).alias("p")).distinct()
    return heads.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n"), "p").select(C.to_string(C.append_last(F.col("p"), F.col("n").cast("int"))).alias("smtid")).distinct()


@query("flatten", "SELECT docid, sum(code) AS total FROM code_pos GROUP BY docid".replace("sum(code)", "CAST(sum(code) AS BIGINT)"))
def _(v):
    nested = F.array(F.slice("codes", 1, 2), F.slice("codes", 3, 2))
    return v.codes.select("docid", F.aggregate(F.flatten(nested), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("partition_equal", "SELECT part, count(*) AS n FROM (SELECT CAST(least(floor((row_number() OVER (ORDER BY docid) - 1) / floor(count(*) OVER () / 7)), 6) AS INTEGER) AS part FROM corpus) GROUP BY part")
def _(v):
    places = numbered(v.corpus.select("docid"), [F.col("docid")], "position")
    total = places.agg(F.count(F.lit(1)).alias("total"))
    rows = places.crossJoin(F.broadcast(total)).select(C.split_equal(F.col("position"), F.col("total"), 7).alias("part"))  # one row
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("saturate", "SELECT docid, round(ln(1 + greatest(len(codes) - codes[1] - 2.0, 0)), 6) AS y FROM doc_codes")
def _(v):
    return v.codes.select("docid", F.round(S.saturate(F.size("codes") - F.get("codes", F.lit(0)) - 2.0), 6).alias("y"))


@query("prefixes_of", "SELECT docid, prefix, next FROM code_edges")
def _(v):
    rows = v.codes.select("docid", F.explode(C.edges(F.col("codes"))).alias("e"))
    return rows.select("docid", C.to_string(F.col("e.prefix")).alias("prefix"), "e.next")


@query("special_tokens", "SELECT DISTINCT CAST(m AS INTEGER) AS position, code, '<docid_' || m || '_' || code || '>' AS token FROM code_pos")
def _(v):
    # of the grid, the tokens that documents use
    used = v.codes.select(F.posexplode("codes").alias("position", "code")).distinct()
    return C.token_grid(v.spark, 4, 8).join(used, ["position", "code"], "left_semi")


@query("code_token_bijection", "SELECT docid, CAST(32000 + m * 8 + code AS INTEGER) AS token, CAST(m AS INTEGER) AS position, code FROM code_pos")
def _(v):
    rows = v.codes.select("docid", F.posexplode("codes").alias("m", "c")).select("docid", C.token_of(F.col("m"), F.col("c"), 8).alias("token"))
    return rows.select("docid", "token", C.position_of(F.col("token"), 8).alias("position"), C.code_of(F.col("token"), 8).alias("code"))


@query("unpack_bits", "SELECT docid, array_to_string(codes, '_') AS codes, CAST(codes[1] + codes[2] * 8 + codes[3] * 64 + codes[4] * 512 AS BIGINT) AS word FROM doc_codes")
def _(v):
    words = v.codes.select("docid", C.pack_bits(F.col("codes"), 3).alias("word"))
    return words.select("docid", C.to_string(C.unpack_bits(F.col("word"), 4, 3)).alias("codes"), "word")


@query("reciprocal_rank", "SELECT qid, docid, CASE WHEN n <= 10 THEN round(1.0::DOUBLE / n, 6) ELSE 0 END AS rr FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS n FROM run_v)")
def _(v):
    return ranking.with_rank(v.run_v).select("qid", "docid", F.round(S.reciprocal_rank(F.col("rank")), 6).alias("rr"))


@query("decay_factor", "SELECT qid, docid, l AS length, round(score * f, 9) AS score FROM run_v, (VALUES (4, 0.5::DOUBLE), (8, 0.75), (16, 0.875), (32, 1.0)) t(l, f)")
def _(v):
    scores = F.array(*(F.struct(F.lit(n).alias("length"), F.get(S.scaled(F.array("score"), S.decay(n)), F.lit(0)).alias("score")) for n in S.DECAY))
    return v.run_v.select("qid", "docid", F.explode(scores).alias("x")).select("qid", "docid", "x.length", F.round("x.score", 9).alias("score"))


@query("reg_weight_schedule", "SELECT docid * 100 AS step, round(0.01 * pow(least(docid * 100, 50000) / 50000, 2), 9) AS weight FROM vectors")
def _(v):
    # a step for each hundred examples, here vectors
    steps = v.vectors.select((F.col("docid") * 100).alias("step"))
    return steps.withColumn("weight", F.round(S.reg_weight(F.col("step"), 0.01, 50000), 9))


@query("tokenize_truncate", "SELECT docid, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:64], ' ') AS tokens FROM corpus")
def _(v):
    return v.corpus.select("docid", F.array_join(S.tokens(F.col("text"), 64), " ").alias("tokens"))


@query("right_shift_codes", "SELECT docid, array_to_string(list_prepend(0, codes[1:3]), '_') AS input FROM doc_codes")
def _(v):
    return v.codes.select("docid", C.to_string(C.shift_right(F.col("codes"))).alias("input"))


@query("concat_lex_smt_codes", "SELECT docid, array_to_string(codes[1:2] || codes, '_') AS both, CAST(2 AS INTEGER) AS split FROM doc_codes")
def _(v):
    lex = F.slice("codes", 1, 2)
    return v.codes.select("docid", C.to_string(F.concat(lex, "codes")).alias("both"), F.size(lex).alias("split"))


# every prefix of up to three codes
@query("trie_lookup", "SELECT w.prefix, coalesce(t.next, 1) AS next FROM (SELECT '' AS prefix UNION ALL SELECT '' || a FROM range(8) x(a) UNION ALL SELECT a || '_' || b FROM range(8) x(a), range(8) y(b) UNION ALL SELECT a || '_' || b || '_' || c FROM range(8) x(a), range(8) y(b), range(8) z(c)) w LEFT JOIN trie t USING (prefix)")
def _(v):
    digits = lambda n: [(F.floor(F.col("id") / 8**k) % 8).cast("int") for k in reversed(range(n))]
    wanted = v.spark.range(1).select(F.array().cast("array<int>").alias("prefix"))
    for n in (1, 2, 3):
        wanted = wanted.unionByName(v.spark.range(8**n).select(F.array(*digits(n)).alias("prefix")))
    found = prefixes.look_up(prefixes.edges(v.codes), wanted)
    return found.select(C.to_string(F.col("prefix")).alias("prefix"), "next")


@query("trie_enumerate", "SELECT DISTINCT array_to_string(codes, '_') AS smtid FROM doc_codes")
def _(v):
    return prefixes.leaves(prefixes.edges(v.codes)).select(C.to_string(F.col("codes")).alias("smtid"))


@query("transition_matrix", "SELECT m AS depth, dense_rank() OVER (PARTITION BY m ORDER BY prefix) - 1 AS state, next FROM trie")
def _(v):
    edges = prefixes.edges(v.codes).select(F.size("prefix").cast("long").alias("depth"), C.to_string(F.col("prefix")).alias("p"), "next")
    return edges.select("depth", (F.dense_rank().over(W.partitionBy("depth").orderBy("p")) - 1).cast("long").alias("state"), "next")


# the logits behind every prefix of a query's own candidates
@query("mask_invalid", "SELECT p.qid, p.prefix, l.code, CASE WHEN t.next IS NULL THEN -1e9 ELSE round(l.part, 6) END AS logit FROM (SELECT DISTINCT qid, m, prefix FROM run_v JOIN code_edges USING (docid)) p JOIN logits l ON l.qid = p.qid AND l.m = p.m LEFT JOIN trie t ON t.m = p.m AND t.prefix = p.prefix AND t.next = l.code")
def _(v):
    held = prefixes.query_edges(v.run_v, v.codes).select("qid", "prefix").distinct().withColumn("m", F.size("prefix"))
    allowed = prefixes.edges(v.codes).select("prefix", F.col("next").alias("code"), F.lit(True).alias("ok"))
    rows = held.join(v.logits, ["qid", "m"]).join(allowed, ["prefix", "code"], "left")
    return rows.select("qid", C.to_string(F.col("prefix")).alias("prefix"), "code", F.when(F.col("ok"), F.round("part", 6)).otherwise(-1e9).alias("logit"))
