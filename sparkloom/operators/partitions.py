"""Comparing partitions, cluster sizes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranking import top_n_each


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): the cells of two partitions that hold rows."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def crosswalk(cells: DataFrame) -> DataFrame:
    """Cells with their share of the row and of the column."""
    row, column = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    return cells.select("a", "b", "n", (F.col("n") / row).alias("row_share"), (F.col("n") / column).alias("column_share"))


def _margins(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n"))
    return cells, rows, cols


def agreement(cells: DataFrame) -> DataFrame:
    """(n, ari, nmi): adjusted Rand index and normalised mutual information (arithmetic mean) of a contingency table."""
    pairs = lambda n: n.cast("double") * (n - 1) / 2
    n = F.col("n")
    both, rows, cols = _margins(cells)
    total = both.agg(F.sum("n").cast("double").alias("total"))

    def sums(df: DataFrame, name: str) -> DataFrame:
        p = n / F.col("total")
        return df.crossJoin(F.broadcast(total)).agg(F.sum(pairs(n)).alias(f"pairs_{name}"), F.sum(-p * F.ln(p)).alias(f"h_{name}"))

    one = total.crossJoin(sums(both, "ab")).crossJoin(sums(rows, "a")).crossJoin(sums(cols, "b"))
    everything = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("pairs_a") * F.col("pairs_b") / F.nullif(everything, F.lit(0.0))
    most = (F.col("pairs_a") + F.col("pairs_b")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("pairs_ab") - expected) / F.nullif(most - expected, F.lit(0.0)))
    mutual = F.greatest(F.col("h_a") + F.col("h_b") - F.col("h_ab"), F.lit(0.0))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    nmi = F.when(mean == 0, 1.0).otherwise(mutual / F.nullif(mean, F.lit(0.0)))
    return one.select(F.col("total").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def majority(cells: DataFrame) -> DataFrame:
    """(a, b, n): each a with its most frequent b; the smallest of equals."""
    return top_n_each(cells, ["a"], [F.desc("n"), F.asc("b")], 1).drop("place")


def cluster_sizes(df: DataFrame, label: str, k: int) -> DataFrame:
    """(n, sizes, min_size, max_size, min_ratio, max_ratio, imbalance) over the clusters 0..k-1, empty ones included."""
    counts = df.sparkSession.range(k).withColumnRenamed("id", label).join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left")
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0)))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(label, "n"))), lambda s: F.concat_ws(":", s[label], s["n"])), ";")
    one = counts.agg(F.sum("n").alias("n"), listed.alias("sizes"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
    total = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    imbalance = F.when(F.col("min_size") > 0, F.col("max_size") / F.col("min_size")).otherwise(F.lit(float("inf")))
    return one.select("*", (F.col("min_size") / total).alias("min_ratio"), (F.col("max_size") / total).alias("max_ratio"), imbalance.alias("imbalance"))


def group_shares(df: DataFrame, label: str) -> DataFrame:
    """(label, size, ratio) of each group."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    return sizes.withColumn("ratio", F.col("size") / F.sum("size").over(Window.partitionBy()))


def profiles(long: DataFrame, label: str) -> DataFrame:
    """(feature, label, mean, z_mean, z_other, z_spread): means of each cluster, raw and in standard deviations of the whole;
    the mean of the other clusters' z-means, and the range over clusters."""
    overall = long.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    means = long.groupBy("feature", label).agg(F.avg("x").alias("mean")).join(overall, "feature")
    z = (F.col("mean") - F.col("_m")) / F.when(F.col("_s") < 1e-12, 1.0).otherwise(F.col("_s"))
    w = Window.partitionBy("feature")
    out = means.withColumn("z_mean", z)
    other = (F.sum("z_mean").over(w) - F.col("z_mean")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return out.select("feature", label, "mean", "z_mean", other.alias("z_other"), (F.max("z_mean").over(w) - F.min("z_mean").over(w)).alias("z_spread"))


def contrasts(long: DataFrame, label: str, n: int = 10) -> DataFrame:
    """The n features of each cluster that differ most from the other clusters, with the direction."""
    gap = F.col("z_mean") - F.col("z_other")
    rows = profiles(long, label).withColumn("contrast", gap).withColumn("direction", F.when(gap > 0, "higher").otherwise("lower"))
    order = F.desc(F.round(F.abs("contrast"), 9))
    return top_n_each(rows, [label], [order, F.asc("feature")], n)


def collapsed_agreement(df: DataFrame, coarse: str, fine: str) -> DataFrame:
    """(n, collapsed_ari): the agreement of two partitions when each fine cluster becomes the coarse one that most of it lies in."""
    cells = contingency(df, fine, coarse)
    most = majority(cells).select("a", F.col("b").alias("c"))
    merged = cells.join(F.broadcast(most), "a").groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.sum("n").alias("n"))
    return agreement(merged).select("n", F.col("ari").alias("collapsed_ari"))
