"""What is summed up by document stays in its task, whatever the number of queries; tokens of a row need no exchange."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators import rank
from mnemospark.operators.postings import build
from mnemospark.plans import catalogue

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 6, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_a_row_are_those_of_the_aggregate(spark):
    rows = [("p", 1, "Redis errors, hashing! errors", "Redis errors and the jwt caches　flies"), ("p", 2, None, "x"), ("q", 3, "tests testing tested", None), ("q", 4, "", "The (matched) and [matched] classes")]
    df = spark.createDataFrame(rows, "project string, id long, what string, why string")
    for x in (df, catalogue.decisions(spark, SF).select("project", "id", "what", "why")):
        got = sorted(map(tuple, text.row_flags(x).collect()), key=repr)
        assert got == sorted(map(tuple, build(x).collect()), key=repr) and got
    assert "Exchange" not in plan(text.row_flags(catalogue.decisions(spark, SF).repartition(16).where("id > 0")).select("token")).split("Generate")[0]


def test_tokenize_aggregates_nothing_and_ids_that_come_twice_count_once(spark, tmp_path):
    assert "HashAggregate" not in plan(catalogue.tokenize(spark, SF).where("token = 'x'")).split("Generate")[0]
    rows = [(1, "alpha beta", "en", "a"), (1, "beta gamma", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.token for r in catalogue.tokenize(spark, str(tmp_path)).collect()) == ["alpha", "beta", "gamma"]


def test_pairs_of_queries_and_documents_are_not_exchanged(spark):
    docs = spark.range(300).select(F.concat(F.lit("p"), F.col("id") % 2).alias("project"), "id", F.lit("shared words here").alias("what"), F.lit("because").alias("why"), F.lit(NOW).alias("created_at"), F.lit(1.0).alias("confidence"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("project"), F.lit("shared words").alias("text"))
    got = rank.weighted(docs, asked)
    assert got.count() == 150 * 50
    assert "hashpartitioning(query_id" not in plan(got).split("BroadcastExchange")[0]


@pytest.mark.parametrize("length", [3, 8, 12])
def test_passages_of_any_length_are_found(spark, tmp_path, length):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(words[:3]), "en", "a"), (2, "before " + " ".join(words) + "more", "en", "a"), (3, "none", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words[30 - length :]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.query_id, r.id) for r in catalogue.expected(spark, str(tmp_path)).collect()] == [(7, 2)]


def test_own_place_counts_all_hits_before_it(spark):
    docs = spark.createDataFrame([(0, 0, "other", "x"), (1, 1, "alpha beta", "x"), (2, 2, "alpha beta", "x"), (3, 3, "none", "x"), (4, 4, "beta", "x")], "id long, nth long, what string, why string")
    q = spark.createDataFrame([(1, "alpha beta", 2, "c"), (2, "beta", 3, "c"), (3, "nowhere", 4, "c"), (4, "alpha", 9, "c")], "query_id long, text string, expected long, category string")
    got = {r.query_id: r.pos for r in rank.evaluate(docs, q).collect()}
    assert got == {1: 2, 2: 5, 3: 5, 4: 0}
