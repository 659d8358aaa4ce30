"""Where queries and their SQL are registered, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that sums in another order compare equal, and without negative zero."""
    return df.select(*[(F.round(f"`{c}`", digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


#: The four features of an order line, as records of their order.
FEATURES = ["quantity", "extendedprice", "discount", "tax"]


#: So many order lines meet their orders in one task, about; few of them are dealt to twelve tasks still.
LINES_A_TASK = 200_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, recording, *FEATURES): order lines as repeated records of an order, labelled by whether it is finished.

    Lines and orders are dealt by order to as many tasks as the lines need, so that a task sorts no more when the tables grow."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("recording"), *[F.col(f"l_{f}").alias(f) for f in FEATURES])
    parts = max(12, ceil(lines.count() / LINES_A_TASK))
    return lines.repartition(parts, "id").join(orders.repartition(parts, "id"), "id")


RECORDS = """records AS (SELECT l_orderkey AS id, CAST(o_orderstatus = 'F' AS INT) AS y, l_linenumber AS recording,
  l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vector)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def embedding_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, feature, x)."""
    return embedding_points(spark, sf_dir).select("id", "label", F.posexplode("vector").alias("feature", "x"))


LONG = """long AS (SELECT vec_id AS id, label, CAST(unnest(range(0, len(embedding))) AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
