"""Ranks, quantiles and top-N without gathering a group in one task."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import few, shuffled, stored


#: At most so many groups have their quantiles, and parts their sums, sent to all tasks.
MAX_GROUPS = 10_000
#: So many distinct values of a group are sorted in one task, about.
PART = 1_000_000


def cumulative_counts(df: DataFrame, by: list[str], value: str, sums: dict[str, Column] | None = None, *, weight: str | None = None, buckets: int = 64, rows: int = 0) -> DataFrame:
    """(*by, value, n, *sums, before, total): each distinct value of each group with its number of rows (or their sum of weight), the
    number of rows with smaller values, and the group's rows. Null values and groups do not count; NaN is the largest value.

    The source is read once: equal values are summed before anything else and the sums are stored. Each group's values are
    then parted at approximate quantiles, buckets of them or as many as keep a part near PART values. These quantiles, a row a group,
    go to all tasks, and running sums go over parts and, within each part, over its values: however large a group is,
    its values are never dealt by group, and only one part is sorted in a task. The result does not depend on the cuts. If it is told
    how many rows there are, it deals as many of their distinct values to a task however many these are, PART about."""
    tasks = ceil(rows / PART)
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"), *[F.sum(c).alias(name) for name, c in (sums or {}).items()])
    with shuffled(df.sparkSession, tasks):
        counts = stored(counts, "distinct-values")
    largest = counts.groupBy(*by).agg(F.count("*").alias("d")).agg(F.max("d")).first()[0] or 0
    buckets = max(buckets, -(-largest // PART))
    cuts = [i / buckets for i in range(1, buckets)]
    edges = few(stored(counts.groupBy(*by).agg(F.percentile_approx(value, cuts, 10 * buckets).alias("_edges")), "group-quantiles"), MAX_GROUPS)
    parted = counts.join(edges, by).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    group = Window.partitionBy(*by)
    below = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parted.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    parts = parts.select(*by, "_part", F.coalesce(below, F.lit(0)).alias("_below"), F.sum("_n").over(group).alias("total"))
    inner = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        parted = parted.repartition(tasks, *by, "_part")
    inside = parted.withColumn("_inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    out = inside.join(few(stored(parts, "group-parts"), MAX_GROUPS * buckets), [*by, "_part"]).withColumn("before", F.col("_below") + F.col("_inside"))
    return out.drop("_part", "_below", "_inside")


def average_rank(descending: bool = False) -> Column:
    """The mean rank of tied rows, from the columns of cumulative_counts."""
    before = F.col("total") - F.col("before") - F.col("n") if descending else F.col("before")
    return before + (F.col("n") + 1) / 2


def average_rank_over(x: Column, by: list[str], *, descending: bool = False) -> Column:
    """The average rank within a window, missing values last: for report-sized tables, such as one row a feature."""
    own = F.when(~F.isnan(x), x)
    order = own.desc_nulls_last() if descending else own.asc_nulls_last()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, own)) - 1) / 2


def average_ranks(df: DataFrame, by: list[str], value: str, *, descending: bool = False, name: str = "rank") -> DataFrame:
    """df with the average rank of each row within its group. Nulls and NaN tie with each other at the bottom in either direction."""
    clean = df.withColumn("_v", F.when(~F.isnan(value), F.col(value)))
    ranked = cumulative_counts(clean, by, "_v").select(*by, "_v", average_rank(descending).alias("_rank"))
    missing = clean.groupBy(*by).agg(F.count("_v").alias("_some"), F.count_if(F.col("_v").isNull()).alias("_none"))
    out = clean.join(ranked, [*by, "_v"], "left").join(few(stored(missing, "missing-values"), MAX_GROUPS), by)
    return out.withColumn(name, F.coalesce("_rank", F.col("_some") + (F.col("_none") + 1) / 2)).drop("_v", "_rank", "_some", "_none")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], *, rows: int = 0) -> DataFrame:
    """(*by, *shares): exact quantiles of each group with linear interpolation, from running counts."""
    return quantiles_of(cumulative_counts(df, by, value, rows=rows), by, value, shares)


def quantiles_of(counted: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """quantiles() from the result of cumulative_counts."""

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))

    aggs, out = [], []
    for name, share in shares.items():
        h = (F.col("total") - 1) * F.lit(share)
        aggs += [at(F.floor(h)).alias(f"_{name}_lo"), at(F.ceil(h)).alias(f"_{name}_hi"), F.max(h - F.floor(h)).alias(f"_{name}_w")]
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")).alias(name))
    return counted.groupBy(*by).agg(*aggs).select(*by, *out)


def adjust_fdr(df: DataFrame, p: str, q: str, by: list[str] | None = None) -> DataFrame:
    """df with the Benjamini-Hochberg q-value of column p; null and NaN p-values get null and do not count.

    q at a value is the least of p * n / rank from there up, rank being the last of its ties. The table has
    a row for each feature tested."""
    own = F.when(~F.isnan(p), F.col(p))
    valid = F.count(own).over(Window.partitionBy(*(by or [])))
    last = F.count(own).over(Window.partitionBy(*(by or [])).orderBy(own.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))
    raw = df.withColumn("_raw", own * valid / last)
    up = Window.partitionBy(*(by or [])).orderBy(own.asc_nulls_last()).rangeBetween(0, Window.unboundedFollowing)
    return raw.withColumn(q, F.when(own.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("_raw").over(up))))).drop("_raw")


def top_n_each(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group; order must end in a unique key. Spark cuts each task's rows to n before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= n)


def mean_rank(ranks: list[str]) -> Column:
    """The mean of several rank columns, nulls skipped."""
    have = [F.when(F.col(r).isNotNull(), 1).otherwise(0) for r in ranks]
    return sum((F.coalesce(F.col(r), F.lit(0.0)) for r in ranks), F.lit(0.0)) / F.nullif(sum(have, F.lit(0)), F.lit(0))


def rank_evidence(features: DataFrame, evidence: dict[str, DataFrame], tops: list[int]) -> DataFrame:
    """features (feature) with each evidence (feature, name), its rank_name (largest first, missing last), mean_rank over all, place and
    top flags. The tables have a row a feature; each joins by it, and features without an evidence stay."""
    out = features.withColumn("_all", F.lit(0))
    for name, table in evidence.items():
        out = out.join(table.select("feature", F.round(name, 9).alias(name)), "feature", "left")
    out = out.select("*", *[average_rank_over(F.col(n), ["_all"], descending=True).alias(f"rank_{n}") for n in evidence])
    out = out.withColumn("mean_rank", F.round(mean_rank([f"rank_{n}" for n in evidence]), 6))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("_all").orderBy("mean_rank", "feature"))).drop("_all")
    return out.select("*", *[(F.col("place") <= n).alias(f"top{n}") for n in tops])
