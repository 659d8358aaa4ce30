"""Representations, clusterings, their stability and consensus."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardised(points: DataFrame) -> DataFrame:
    """points (id, vector, ...) with features: the vector in standard deviations."""
    data = points.withColumn("_raw", array_to_vector(F.col("vector").cast("array<double>")))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(data).transform(data).drop("_raw")


def principal(data: DataFrame, k: int) -> DataFrame:
    """data with features replaced by their first k principal components."""
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(data).transform(data).drop("features").withColumnRenamed("_pc", "features")


def components_for(data: DataFrame, width: int, share: float = 0.9) -> int:
    """The least number of components that explain the share of the variance."""
    explained = PCA(k=width, inputCol="features", outputCol="_pc").fit(data).explainedVariance.toArray()
    return int(np.searchsorted(np.cumsum(explained), share) + 1)


def consensus(runs: DataFrame) -> DataFrame:
    """(label_pairs: within, between, separation) of runs (id, run, label, whole): how often two points of one final cluster, and of
    different ones, share a cluster over the runs that hold both.

    Pairs are counted, never listed: those of a run that share a cluster and a final label come from the cell sizes."""
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n").cast("double")
    cells = runs.groupBy("run", "label", "whole").agg(F.count("*").alias("n"))
    together_within = cells.groupBy("run").agg(F.sum(pairs(n)).alias("tw"))
    together = cells.groupBy("run", "label").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(pairs(n)).alias("t"))
    within = cells.groupBy("run", "whole").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(pairs(n)).alias("w"))
    total = cells.groupBy("run").agg(F.sum("n").alias("n")).select("run", pairs(n).alias("all"))
    one = together_within.join(together, "run").join(within, "run").join(total, "run").agg(F.sum("tw").alias("tw"), F.sum("t").alias("t"), F.sum("w").alias("w"), F.sum("all").alias("all"))
    inside = F.col("tw") / F.nullif(F.col("w"), F.lit(0.0))
    outside = (F.col("t") - F.col("tw")) / F.nullif(F.col("all") - F.col("w"), F.lit(0.0))
    return one.select(inside.alias("within"), outside.alias("between"), (inside - outside).alias("separation"))


def coordinates(data: DataFrame) -> DataFrame:
    """(id, pc1, pc2): the first two principal components."""
    return principal(data, 2).select("id", vector_to_array("features")[0].alias("pc1"), vector_to_array("features")[1].alias("pc2"))
