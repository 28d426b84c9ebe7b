"""Labelled retrieval sets, and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SET = "decisions array<struct<id: string, what: string, why: string, domain: string>>, queries array<struct<query: string, expected_id: string, category: string>>"


def labelled_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records: id, nth, what, why, domain; queries: query_id, text, expected, category) of a JSON object with both lists."""
    whole = spark.read.schema(SET).option("multiLine", True).json(path)
    records = whole.select(F.posexplode("decisions").alias("nth", "d")).select("d.id", F.col("nth").cast("long").alias("nth"), "d.what", "d.why", "d.domain")
    queries = whole.select(F.posexplode("queries").alias("query_id", "q")).select("query_id", F.col("q.query").alias("text"), F.col("q.expected_id").alias("expected"), "q.category")
    return records, queries


def json_lines(df: DataFrame) -> DataFrame:
    """One column, a JSON object for each row with its nulls: for a text sink, or to be shown."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)
