"""Every query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "embeddings", "pages", "lineitem"]
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    return Counter(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    want = con.sql(SQL[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(map(tuple, got.select(*[f"`{c}`" for c in want.columns]).collect())) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_full_limits_are_reached(spark):
    from pyspark.sql import functions as F

    q = registry.queries()
    most = lambda df, *group: df.groupBy(*group).count().agg(F.max("count")).first()[0]
    assert {r["n"] for r in q["negatives_top200_full"](spark, SF).collect()} == {200}
    for name in ("add_qrel_to_rerank_full", "add_qrel_to_merged_rerank_full"):
        assert most(q[name](spark, SF), "qid", "rel_docid") == 201
    assert most(q["same_prefix_rerank_full"](spark, SF), "qid", "rel_docid") == 50
    assert most(q["rq_search_full"](spark, SF), "qid") == 500  # all vectors
    assert q["bow_docids_full"](spark, SF).agg(F.max(F.size(F.split("terms", " ")))).first()[0] == 64


def test_strata_of_groups_beyond_200(spark):
    # only sf0.1 has so many vectors of one first code
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    want = con.sql(SQL["hard_negative_rerank_full"])
    got = registry.queries()["hard_negative_rerank_full"](spark, "/root/testdata/sf0.1").select(*want.columns).collect()
    assert max(Counter((r["qid"], r["rel_docid"]) for r in got).values()) == 200
    assert rows(map(tuple, got)) == rows(want.fetchall())


def test_cuts_of_deep_queries_bind(spark):
    from pyspark.sql import functions as F

    sf, q = "/root/testdata/sf0.01", registry.queries()
    most = lambda name: q[name](spark, sf).groupBy("qid").count().agg(F.max("count")).first()[0]
    assert most("make_trainset_full") == 200  # of 250 scored
    assert most("keep_top100_smtids_full") == most("most_common_prefixes_full") == 100  # of more than 300 strings
    assert {100, 1000} <= {r["bucket"] for r in q["rank_bucket_full"](spark, sf).collect()}
