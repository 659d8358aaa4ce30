"""Contracts, descriptive statistics and crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranking import MAX_GROUPS, average_rank, cumulative_counts, quantiles, quantiles_of
from sparkloom.sources.shared import few, stored


def to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(*ids, feature, x): one row for each value, NaN as null."""
    x = F.when(~F.isnan("x"), F.col("x"))
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(ids, features, "feature", "x").withColumn("x", x)


def describe(long: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """(*by, n, mean, std, median, min, max, iqr) of each group; std has n - 1 degrees of freedom, quantiles interpolate.

    The plain figures come first and are stored, a row a group; their sizes tell how many tasks the quantiles' values need."""
    x = F.col(value)
    plain = long.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    plain = stored(plain, "plain-figures")
    q = quantiles(long, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows=plain.agg(F.sum("n")).first()[0] or 0)
    return plain.join(q, by, "left").select(*by, "n", "mean", "std", "median", "min", "max", (F.col("q3") - F.col("q1")).alias("iqr"))


def describe_with_total(long: DataFrame, label: str) -> DataFrame:
    """describe() by (scope, label, feature): all rows together and each label's rows, from one pass over long."""
    scopes = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("label")), F.struct(F.lit("label").alias("scope"), F.col(label).cast("string").alias("label")))
    rows = long.select("feature", "x", F.explode(scopes).alias("s")).select("s.scope", "s.label", "feature", "x")
    return describe(rows, ["scope", "label", "feature"])


def median_deviation(long: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """(*by, iqr, mad): interquartile range, and the median distance from the median, unscaled."""
    counted = stored(cumulative_counts(long, by, value), "running-counts")
    q = stored(quantiles_of(counted, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "group-medians")
    away = counted.join(few(q, MAX_GROUPS), by).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    mad = quantiles_of(cumulative_counts(away, by, "_away", weight="n"), by, "_away", {"mad": 0.5})
    return q.join(mad, by).select(*by, (F.col("q3") - F.col("q1")).alias("iqr"), "mad")


def crosstab(df: DataFrame, row: str, column: str, columns: list, *, margins: bool = False) -> DataFrame:
    """(row as string, one count for each of columns): zero where none, with 'All' margins if asked for."""
    counts = df.groupBy(row, column).count()
    cells = [F.coalesce(F.sum(F.when(F.col(column) == c, F.col("count"))), F.lit(0)).alias(str(c)) for c in columns]
    total = [F.sum("count").alias("All")] if margins else []
    grouped = counts.rollup(row) if margins else counts.groupBy(row)
    name = F.when(F.grouping(row) == 1, "All").otherwise(F.col(row).cast("string")) if margins else F.col(row).cast("string")
    return grouped.agg(name.alias("_name"), *cells, *total).drop(row).withColumnRenamed("_name", row)


def subject_table(records: DataFrame, key: str, features: list[str], constant: list[str]) -> DataFrame:
    """One row for each subject: the constant columns, record_count and each feature's mean, in one aggregation."""
    return records.groupBy(key).agg(
        *[F.min(c).alias(c) for c in constant],
        F.count("*").alias("record_count"),
        *[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in features],
    )


def size_distribution(df: DataFrame, key: str) -> DataFrame:
    """(size, n): how many groups have each size."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def conflicts(df: DataFrame, key: str, column: str) -> DataFrame:
    """(groups, conflicting): groups with more than one value of column, null being a value."""
    most, least = F.max(column), F.min(column)
    mixed = (most != least) | (most.isNotNull() & (F.count(column) < F.count("*")))
    per = df.groupBy(key).agg(F.coalesce(mixed, F.lit(False)).alias("mixed"))
    return per.agg(F.count("*").alias("groups"), F.count_if("mixed").alias("conflicting"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, n_distinct, n_duplicate) over these columns. Rows meet by hash, so a much repeated row is counted map-side."""
    per = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))


def null_census(df: DataFrame) -> DataFrame:
    """(column, n_missing): nulls, and NaN in floating columns, all in one pass."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}

    def missing(c: str) -> Column:
        return F.count_if(F.col(c).isNull() | (F.isnan(c) if c in floats else F.lit(False)))

    one = df.agg(*[missing(c).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "n_missing")


def feature_audit(long: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(feature, n, n_missing, n_distinct, std, is_constant, is_near_constant) of each feature; std is that of the population."""
    basic = long.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing"), F.stddev_pop("x").alias("std"))
    distinct = long.groupBy("feature", "x").agg(F.count("*").alias("_")).groupBy("feature").agg(F.count("x").alias("n_distinct"))
    out = basic.join(distinct, "feature")
    return out.select("feature", "n", "n_missing", "n_distinct", "std", (F.col("n_distinct") <= 1).alias("is_constant"), F.coalesce(F.col("std") <= tolerance, F.lit(True)).alias("is_near_constant"))


def feature_zscores(long: DataFrame) -> DataFrame:
    """long (feature, x, ...) with z: x in population standard deviations from its feature's mean; 0 in a constant feature. Means are a row a
    feature, which goes to all tasks up to 100,000 features."""
    sizes = few(stored(long.groupBy("feature").agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_spread")), "feature-sizes"), 100_000)
    z = (F.col("x") - F.col("_mean")) / F.when(F.col("_spread") < 1e-12, 1.0).otherwise(F.col("_spread"))
    return long.join(sizes, "feature", "left").withColumn("z", z).drop("_mean", "_spread")


def running_ranks(long: DataFrame) -> DataFrame:
    """(feature, x, n, rank): the average rank of each distinct value of each feature."""
    return cumulative_counts(long, ["feature"], "x").select("feature", "x", "n", average_rank().alias("rank"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """(n_features, n_missing, n_constant, n_near_constant, flagged) of a feature_audit: one row, with the names of the near-constant ones."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_near_constant"), F.col("feature")))), lambda x: x.cast("string")), "; ")
    return audit.agg(
        F.count("*").alias("n_features"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"), F.count_if("is_constant").alias("n_constant"), F.count_if("is_near_constant").alias("n_near_constant"), names.alias("flagged"),
    )


def label_distribution(records: DataFrame, key: str, label: str) -> DataFrame:
    """(label, n_subjects, n_records): subjects count once, with the label that their records share."""
    per = records.groupBy(key).agg(F.min(label).alias(label), F.count("*").alias("r"))
    return per.groupBy(label).agg(F.count("*").alias("n_subjects"), F.sum("r").alias("n_records"))
