"""Small cases that can be checked by hand, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import codes as C
from lodestone.functions import scores as S
from lodestone.operators import analysis, beam, metrics, prefixes, quantize, ranking, sampling, sparse, training
from lodestone.plans.views import Views, beams_of
from lodestone.sources import formats

SF = "/root/testdata/sf0.001"


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def run(spark, rows):
    return spark.createDataFrame(rows, "qid long, docid long, score double")


def qrels(spark, rows):
    return spark.createDataFrame(rows, "qid long, docid long, rel int")


def test_set_scores_count_repeated_terms(spark):
    q = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "qid long, term string, weight double")
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "docid long, term string")
    assert values(sparse.score_sets(q, d), "docid", "score") == [(1, 3.0), (2, 4.0)]
    assert values(sparse.retrieve_sets(q, d, 3), "docid", "score") == [(1, 3.0), (2, 4.0), (3, 0.0)]


def test_threshold_is_strict(spark):
    q = spark.createDataFrame([(1, "a", 0.0), (1, "b", 1.0)], "qid long, term string, weight double")
    d = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], "term string, docid long, value double")
    assert values(sparse.score(q, d), "docid") == [(2,)]


def test_metrics_by_hand(spark):
    r = run(spark, [(1, i, 1.0 / i) for i in range(1, 13)] + [(2, 1, 1.0), (3, 5, 1.0)])
    j = qrels(spark, [(1, 3, 1), (2, 9, 1), (4, 1, 1)])
    assert values(metrics.reciprocal_ranks(r, j, 10), "qid", "rr") == [(1, 1 / 3), (2, 0.0)]
    assert values(metrics.reciprocal_ranks(r, qrels(spark, [(1, 11, 1)]), 10), "rr") == [(0.0,)]
    two = metrics.per_query(r, qrels(spark, [(1, 1, 1), (1, 2, 1), (1, 98, 1), (1, 99, 1)]), 10).first()
    assert two["recall"] == 0.5 and two["precision"] == 0.2
    graded = metrics.per_query(run(spark, [(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0)]), qrels(spark, [(1, 2, 2), (1, 3, 1)]), 3).first()
    assert graded["ndcg"] == pytest.approx((2 / math.log2(3) + 1 / 2) / (2 + 1 / math.log2(3)))
    assert metrics.per_query(run(spark, []), j, 10).collect() == []
    with pytest.raises(ValueError):
        metrics.check_metric("recall", graded=True)


def test_parts_take_the_remainder_last(spark):
    parts = spark.range(10).select(C.split_equal(F.col("id"), F.lit(10), 3).alias("p")).groupBy("p").count()
    assert values(parts, "p", "count") == [(0, 3), (1, 3), (2, 4)]


def codes_of(spark, rows):
    return spark.createDataFrame(rows, "docid long, codes array<int>")


def test_prefix_tree_and_pooling(spark):
    c = codes_of(spark, [(1, [1, 2]), (2, [1, 3]), (3, [4, 2])])
    assert values(prefixes.edges(c), "prefix", "next") == [([], 1), ([], 4), ([1], 2), ([1], 3), ([4], 2)]
    assert values(prefixes.leaves(prefixes.edges(c)), "codes") == [([1, 2],), ([1, 3],), ([4, 2],)]
    r = run(spark, [(1, 1, 5.0), (1, 2, 1.0)])
    pooled = {how: prefixes.pooled(r, c, how).where(F.size("prefix") == 0).first()["lex"] for how in ("max", "min", "mean")}
    assert pooled == {"max": 5.0, "min": 1.0, "mean": 3.0}
    wanted = spark.createDataFrame([([1],), ([9],)], "prefix array<int>")
    assert values(prefixes.look_up(prefixes.edges(c), wanted), "prefix", "next") == [([1], 2), ([1], 3), ([9], 1)]


def test_guidance_selects_but_is_not_carried(spark):
    q = spark.createDataFrame([(1,)], "qid long")
    c = codes_of(spark, [(1, [1]), (2, [4])])
    logits = spark.createDataFrame([(1, 0, 1, 0.2), (1, 0, 4, 0.5)], "qid long, m int, code int, part double")
    lexical = prefixes.pooled(run(spark, [(1, 1, 5.0), (1, 2, 0.0)]), c)
    found = beam.search(q, prefixes.edges(c), logits, 1, 1, lexical)
    assert values(found, "codes", "score") == [([1], 0.2)]
    assert values(beam.search(q, prefixes.edges(c), logits, 1, 1), "codes") == [([4],)]


def test_collisions_return_both_documents(spark):
    beams = spark.createDataFrame([(1, [1, 2], 0.5)], "qid long, codes array<int>, score double")
    assert values(beam.documents(beams, codes_of(spark, [(7, [1, 2]), (8, [1, 2]), (9, [1, 3])])), "docid", "score") == [(7, 0.5), (8, 0.5)]


def test_wide_beams_find_what_scoring_all_finds(spark):
    v = Views(spark, SF)
    found = beams_of(v, "constrained", beams=10_000)
    every = quantize.search_scores(v.logits, v.codes).join(v.codes, "docid").groupBy("qid", "codes").agg(F.max("score").alias("s"))
    joined = found.join(every, ["qid", "codes"])
    assert joined.count() == every.count() == found.count()
    assert joined.where(F.abs(F.col("score") - F.col("s")) > 1e-9).count() == 0


def test_merging(spark):
    a, b = run(spark, [(1, 1, 1.0)]), run(spark, [(1, 1, 9.0), (1, 2, 3.0)])
    assert values(ranking.merge_first_wins(a, b, ["qid", "docid"]), "docid", "score") == [(1, 1.0), (2, 3.0)]
    assert values(ranking.merge_max([a, b], ["qid", "docid"]), "docid", "score") == values(ranking.merge_max([b, a, b], ["qid", "docid"]), "docid", "score") == [(1, 9.0), (2, 3.0)]


def test_top_k_is_a_prefix_of_the_next(spark):
    r = run(spark, [(q, d, float(d % 3)) for q in range(3) for d in range(9)])
    three, four = (set(values(ranking.top_k(r, k), "qid", "docid")) for k in (3, 4))
    assert three < four and len(four) == 12
    assert set(values(ranking.top_k(r, 99), "qid", "docid")) == set(values(r, "qid", "docid"))


def test_examples_start_with_the_positive(spark):
    r = run(spark, [(1, d, float(d)) for d in range(300)] + [(2, 5, 1.0)])
    pos = run(spark, [(1, 10, 0.1), (3, 1, 1.0)])
    rows = training.add_positives(r, pos)
    got = training.examples(rows, "qid").collect()
    assert len(got) == 1 and got[0]["docids"][0] == 10 and len(got[0]["docids"]) == 201
    assert 10 not in got[0]["docids"][1:] and got[0]["docids"][1] == 299
    whole = formats.parse_examples(formats.format_examples(training.examples(rows, "qid")))
    assert whole.count() == 201


def test_strata_keep_small_groups_whole(spark):
    ranks = spark.range(10).select(F.lit(1).alias("qid"), F.col("id").alias("docid"), (F.col("id") + 1).alias("rank"), F.lit(10).alias("size"))
    assert sampling.stratified(ranks, 5, 10, ["qid"]).count() == 10
    kept = sampling.stratified(ranks, 5, 5, ["qid"])
    assert sorted((r["rank"] - 1) // 2 for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_quantiles_and_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    found = dict(values(analysis.quantiles(df, "x"), "q", "value"))
    assert found[0.1] == pytest.approx(1.2) and found[0.5] == 2.0
    assert spark.createDataFrame([(1.0,), (3.0,)], "x double").agg(F.stddev_pop("x")).first()[0] == 1.0
    bins = dict(values(analysis.histogram(spark.createDataFrame([(1.0,), (0.0,), (-0.7,)], "x double"), "x"), "bin", "share"))
    assert bins[9] == bins[5] == bins[0] == pytest.approx(1 / 3) and len(bins) == 10


def test_losses_by_hand(spark):
    pairs = spark.createDataFrame([(2.0, 1.0, 5.0, 1.0)], "s_pos double, s_neg double, t_pos double, t_neg double")
    assert training.margins(pairs).first()[0] == 9.0
    scores = spark.createDataFrame([(1, 2.0, 1.0), (1, 1.0, 0.0)], "qid long, s double, t double")
    assert training.ranknet(scores).first()[0] == pytest.approx(math.log(1 + math.exp(-1)))
    p, q = math.e / (1 + math.e), math.log(math.e / (1 + math.e))
    assert training.soft_cross_entropy(scores).first()[0] == pytest.approx(-(p * q + (1 - p) * math.log(1 - p)))
    logits = spark.createDataFrame([(1, 0, 1.0, 0), (1, 1, 0.0, 0)], "step int, code int, logit double, target int")
    assert training.cross_entropy(logits).first()[0] == pytest.approx(-q)
    assert training.binary_cross_entropy(spark.createDataFrame([(0.0, 1)], "x double, y int")).first()[0] == pytest.approx(math.log(2))


def test_code_strings_and_bits(spark):
    c = codes_of(spark, [(1, [5, 0, 7, 3])])
    row = c.select(C.to_string(F.col("codes")).alias("s"), C.unpack_bits(C.pack_bits(F.col("codes"), 3), 4, 3).alias("u"), C.from_string(F.lit("5_0")).alias("p"), C.shift_right(F.col("codes")).alias("r")).first()
    assert (row["s"], row["u"], row["p"], row["r"]) == ("5_0_7_3", [5, 0, 7, 3], [5, 0], [0, 5, 0, 7])


def test_codes_never_increase_the_residual(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.2]), (2, [0.1, 0.1])], "docid long, vec array<double>")
    book = spark.createDataFrame([(m, c, v) for m in range(2) for c, v in enumerate([[0.0, 0.0], [0.9, 0.1]])], "m int, code int, vec array<double>")
    codes = quantize.encode(vectors, book, 2)
    assert values(codes, "docid", "codes") == [(1, [1, 0]), (2, [0, 0])]
    assert values(quantize.reconstruct(codes.where("docid = 1"), book), "dim", "value") == [(0, 0.9), (1, 0.1)]


def test_indexes_must_not_share_documents(spark):
    a = spark.createDataFrame([("x", 1, 1.0)], "term string, docid long, value double")
    b = spark.createDataFrame([("x", 2, 1.0)], "term string, docid long, value double")
    assert sparse.merge_indexes(a, b).count() == 2
    with pytest.raises(Exception, match="both indexes"):
        sparse.merge_indexes(a, a).collect()


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(values(Views(spark, SF).run_a, "qid", "docid", "score"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_scores_by_hand(spark):
    row = spark.range(1).select(S.saturate(F.lit(-1.0)).alias("a"), S.reciprocal_rank(F.lit(11)).alias("b"), S.reg_weight(F.lit(5), 2.0, 10).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (0.0, 0.0, 0.5)


def test_trained_codebook_matches_plain_lloyd(spark):
    import numpy as np

    from lodestone.operators import quantize

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "docid long, vec array<double>").repartition(3)
    order = [[r[0] for r in df.orderBy(F.xxhash64("docid", F.lit(0), F.lit(m)), "docid").limit(5).collect()] for m in range(2)]
    want, left = [], x
    for m in range(2):
        centers = left[order[m]].copy()
        for _ in range(4):
            near = ((left[:, None] - centers) ** 2).sum(-1).argmin(1)
            centers = np.array([left[near == c].mean(0) if (near == c).any() else centers[c] for c in range(5)])
        near = ((left[:, None] - centers) ** 2).sum(-1).argmin(1)
        left = left - centers[near]
        want += [(m, c, v) for c, v in enumerate(centers)]
    got = {(r["m"], r["code"]): r["vec"] for r in quantize.train(df, 2, 5, rounds=4, start="hash").collect()}
    assert len(got) == 10 and all(np.allclose(got[m, c], v, atol=1e-9) for m, c, v in want)


def test_code_scores_in_blocks_and_with_gaps(spark, monkeypatch):
    from lodestone.operators import quantize

    codes = [(1, [0, 1]), (2, [1, 1]), (3, [2]), (4, [9, 9]), (5, [])]
    parts = [(q, m, c, float(10 * q + 3 * m + c)) for q in range(7) for m in range(2) for c in range(3) if (q, m, c) != (3, 1, 1)]
    want = {(q, d): sum(p for q_, m, c, p in parts if q_ == q and m < len(x) and x[m] == c) for q in range(7) for d, x in codes if any(m < len(x) and x[m] == c and q_ == q for q_, m, c, _ in parts)}
    for table in (quantize.TABLE, 5):
        monkeypatch.setattr(quantize, "TABLE", table)
        got = quantize.search_scores(spark.createDataFrame(parts, "qid long, m int, code int, part double"), spark.createDataFrame(codes, "docid long, codes array<int>"), levels=2)
        assert {(r["qid"], r["docid"]): r["score"] for r in got.collect()} == want


def test_dense_blocks_and_indexes(spark, tmp_path, monkeypatch):
    import numpy as np
    import pytest

    from lodestone.operators import dense

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(60, 4)).astype(float)  # many equal scores
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "docid long, vec array<double>").repartition(4)
    queries = df.where("docid % 4 = 0").select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))
    want = {(q, d) for q in range(0, 60, 4) for d in sorted((d for d in range(60) if d != q), key=lambda d: (-x[q] @ x[d], d))[:5]}
    for size, sent in ((1024, 1 << 20), (2, 1 << 20), (2, 0)):
        monkeypatch.setattr(dense, "BLOCK", size)
        monkeypatch.setattr(dense, "SENT", sent)
        got = dense.retrieve_blocked(queries, df, 5, but_self=True).collect()
        assert len(got) == len(want) and {(r["qid"], r["docid"]) for r in got} == want
        assert dense.retrieve_blocked(queries.limit(0), df, 5).collect() == dense.retrieve_blocked(queries, df.limit(0), 5).collect() == []
    paths = [f"file://{tmp_path}/{r}" for r in range(3)]
    for r, path in enumerate(paths):
        dense.write_index(df.where(F.col("docid") % 3 == r), path)
    dense.merge_indexes(spark, paths, f"file://{tmp_path}/all")
    assert {r["idx"]: r["docid"] for r in dense.read_index(spark, f"file://{tmp_path}/all").collect()} == {i: i for i in range(60)}
    with pytest.raises(ValueError):
        dense.merge_indexes(spark, [paths[0], paths[0]], f"file://{tmp_path}/twice")


def test_passages_are_found_by_their_runs_of_words(spark, monkeypatch):
    from lodestone.operators import sparse

    texts = [(1, "xx one two three four five six yy"), (2, "one two  three four five six"), (3, "one two three"), (4, None), (5, ""), (6, "a one two three four fiv")]
    passages = [(10, "ne two three four five si"), (11, "one two"), (12, "two three four five six y"), (13, "nowhere to be seen at all"), (14, "one two three four fi")]
    want = {(q, d) for q, p in passages for d, t in texts if t and p in t}
    args = spark.createDataFrame(texts, "docid long, text string"), spark.createDataFrame(passages, "qid long, text string")
    for few in (sparse.FEW_PASSAGES, 0):
        monkeypatch.setattr(sparse, "FEW_PASSAGES", few)
        assert {tuple(r) for r in sparse.containing(*args).collect()} == want


def test_scorers_of_pairs_run_in_batches(spark):
    from lodestone.operators import rerank

    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "qid long, docid long")
    topics = spark.createDataFrame([(1, "A b"), (2, "c")], "qid long, text string")
    corpus = spark.createDataFrame([(7, "a b c d"), (8, "b, B!")], "docid long, text string")
    got = {(r["qid"], r["docid"]): r["score"] for r in rerank.score_pairs(pairs, topics, corpus, batch=1).collect()}
    assert got == {(1, 7): 0.5, (1, 8): 0.5, (2, 7): 0.25}
    longer = rerank.score_pairs(pairs, topics, corpus, scorer=lambda q, t: [len(x) - len(y) for x, y in zip(q, t)])
    assert {r["score"] for r in longer.collect()} == {-4.0, -2.0, -6.0}


def test_numbered_counts_ranges(spark):
    from lodestone.sources.shared import numbered

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit("a").alias("row")).repartition(5)
    assert all(r["n"] == r["x"] for r in numbered(df, [F.col("x")], "n").collect())
    assert numbered(df.limit(0), [F.col("x")], "n").collect() == []


def plain_best(scores, k):
    """The k best (qid, docid, score) of each query; scores by (qid, docid)."""
    out = []
    for q in {q for q, _ in scores}:
        mine = sorted(((-round(s, 6), d) for (q_, d), s in scores.items() if q_ == q))[:k]
        out += [(q, d, -s) for s, d in mine]
    return sorted(out)


def test_code_scan_of_eight_positions(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import quantize

    rng = np.random.default_rng(5)
    docs = [(f"d{i:03}", [int(c) for c in rng.integers(0, 3, 8 if i % 7 else i % 5)]) for i in range(300)]
    parts = [(q, m, c, float(10**m)) for q in range(4) for m in range(8) for c in (1, 2) if (q, m, c) != (1, 7, 2)] + [(9, 0, 5, 1.0), (3, 0, 0, None)]
    scores = {}
    for q in range(4):
        for d, x in docs:
            found = [float(10**m) for m, c in enumerate(x) if c in (1, 2) and (q, m, c) != (1, 7, 2)]
            if found:
                scores[q, d] = sum(found)
    schema = "qid long, m int, code int, part double", "docid string, codes array<int>"
    args = spark.createDataFrame(parts, schema[0]), spark.createDataFrame(docs, schema[1]).repartition(5)
    every = {(r["qid"], r["docid"]): r["score"] for r in quantize.search_scores(*args).collect()}
    assert {k: v for k, v in every.items() if v is not None} == scores and max(scores.values()) > 10**7
    for table in (quantize.TABLE, 20):
        monkeypatch.setattr(quantize, "TABLE", table)
        got = quantize.scan(*args, 7)
        assert sorted(map(tuple, got.select("qid", "docid", "score").collect())) == plain_best(scores, 7)
    assert quantize.scan(args[0].limit(0), args[1], 7).count() == 0
    assert quantize.search_scores(args[0].limit(0), args[1]).count() == 0


def test_best_of_batches():
    import numpy as np

    from lodestone.operators import kernels

    rng = np.random.default_rng(6)
    top, scores = kernels.Best(3, 5), {}
    for _ in range(40):
        q, d = rng.integers(0, 3, 50), rng.integers(0, 10**6, 50)
        s = rng.integers(0, 9, 50) / 4
        scores |= {(int(a), int(b)): float(c) for a, b, c in zip(q, d, s)}
        keep = [i for i in range(50) if scores[int(q[i]), int(d[i])] == s[i]]
        top.add(q[keep], d[keep], s[keep])
        if rng.random() < 0.3:
            top.settle()
    assert sorted((int(a), int(b), float(c)) for a, b, c in zip(*top.settle())) == plain_best(scores, 5)


def test_block_index_matches_all_scores(spark, tmp_path):
    import random

    from lodestone.operators import blocks

    rng = random.Random(7)
    postings = {}
    for d in range(400):
        for t in {rng.choice(["the", "of", "a", *map(str, range(60))]) for _ in range(rng.choice([1, 3, 40]))}:
            postings[t, f"d{d:03}"] = rng.choice([0.5, 1.0, 1.0, -0.25, 3.0])
    queries = [(q, t, rng.choice([1.0, 0.5, -1.0])) for q in range(12) for t in rng.sample(["the", "of", "a", *map(str, range(70))], 6)] + [(0, None, 1.0)]
    scores = {}
    for q, t, w in queries:
        for (t_, d), x in postings.items():
            if t == t_:
                scores[q, d] = scores.get((q, d), 0.0) + w * x
    index = spark.createDataFrame([(t, d, x) for (t, d), x in postings.items()], "term string, docid string, value double").repartition(3)
    asked = spark.createDataFrame(queries, "qid long, term string, weight double")
    for k, threshold in ((3, 0.75), (1000, -100.0)):
        want = plain_best({x: s for x, s in scores.items() if round(s, 6) > threshold}, k)
        for size, window in ((10**6, 64), (900, 4)):
            built = blocks.build(index, f"file://{tmp_path}/{k}-{size}", size, window)
            got = blocks.retrieve(asked, built, k, threshold, window).select("qid", "docid", F.round("score", 6)).collect()
            assert sorted(map(tuple, got)) == [(q, d, round(s, 6)) for q, d, s in want]
    shards = built.select("shard").distinct().count()
    assert shards > 2
    plan = blocks.retrieve(asked, built, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(shard" not in plan
    again = blocks.read(spark, f"file://{tmp_path}/1000-900", -(-len(postings) // 900), "string")
    assert again.agg(F.sum(F.size("places"))).first()[0] == len(postings)
    assert blocks.retrieve(asked, again, 1000, -100.0, 4).count() == len(want)
    assert blocks.retrieve(asked.limit(0), built, 3).count() == 0
    assert blocks.retrieve(asked, blocks.build(index.limit(0)), 3).count() == 0


def test_blocks_below_the_best_are_skipped(spark):
    from lodestone.operators import blocks, sparse
    from lodestone.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.1")
    index = blocks.build(sparse.postings(sparse.term_weights(v.corpus, "docid", among=v.topic_weights)))
    blocks_, scored = blocks.skips(v.topic_weights, index, 10).agg(F.sum("blocks"), F.sum("scored")).first()
    assert scored < blocks_ / 2


def _error(x, book, levels):
    import numpy as np

    used = []
    for m in range(levels):
        centers = np.array([v for (m_, _), v in sorted(book.items()) if m_ == m])
        near = ((x[:, None] - centers) ** 2).sum(-1).argmin(1)
        used.append(set(near.tolist()))
        x = x - centers[near]
    return (x**2).sum(), used


def test_codebooks_have_no_dead_codes(spark):
    import numpy as np

    from lodestone.operators import quantize

    # clumps of very different sizes, many equal vectors
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(600, 4)) * 0.01, np.repeat(rng.normal(size=(1, 4)), 200, axis=0), rng.normal(size=(40, 4)) * 20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "docid long, vec array<double>").repartition(3)
    error = {}
    for start in ("picked", "hash"):
        book = {(r["m"], r["code"]): r["vec"] for r in quantize.train(df, 2, 16, rounds=4, start=start).collect()}
        error[start], used = _error(x, book, 2)
        assert used == [set(range(16))] * 2
    assert error["picked"] <= error["hash"]
    few = df.where("docid >= 600 AND docid < 803")  # four different vectors
    book = {(r["m"], r["code"]): r["vec"] for r in quantize.train(few, 1, 8, rounds=2).collect()}
    assert len({tuple(v) for v in book.values()}) == 4 and len(book) == 8


def test_a_state_travels_with_the_beam(spark):
    import itertools

    import numpy as np

    from lodestone.operators import rerank

    sequences = [(i, list(c)) for i, c in enumerate(itertools.product(range(3), repeat=3)) if i % 4]
    trie = prefixes.edges(codes_of(spark, sequences))
    queries = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(3)], "qid long, state array<double>")
    calls = spark.sparkContext.accumulator(0)

    def scorer(states, last, length):
        # the state folds all codes read; the scores depend on it and so on the whole prefix
        calls.add(len(states))
        states = np.stack([states[:, 0], states[:, 1] * 3 + last + 1], axis=1)
        return np.cos(states[:, :1] + states[:, 1:] * (1 + np.arange(3)) + length), states

    def plain(q, codes):
        fold, last, total = 1.0, -1, 0.0
        for m, c in enumerate(codes):
            fold = fold * 3 + last + 1
            total += float(np.cos(q + fold * (1 + c) + m))
            last = c
        return total

    want = set()
    for q in range(3):
        beam_ = [[]]
        for m in range(3):
            step = {tuple(b + [c]) for b in beam_ for c in range(3) if any(x[: m + 1] == b + [c] for _, x in sequences)}
            beam_ = [list(x) for x in sorted(step, key=lambda x: (-round(plain(q, x), 6), x))[:4]]
        want |= {(q, tuple(x), round(plain(q, x), 6)) for x in beam_}
    found = beam.search(queries, trie, rerank.Stateful(scorer), 3, 4)
    assert {(r["qid"], tuple(r["codes"]), round(r["score"], 6)) for r in found.collect()} == want
    # one call for a query, then one for each of its hypotheses
    assert calls.value == 3 * (1 + 3 + 4)
