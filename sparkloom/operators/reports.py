"""Tables that describe clusters: assignments, dominant categories, profiles with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a category of features reads in a label.
PHRASES = {
    "Delta / Delta-delta": "dynamic_delta", "TQWT": "tqwt", "MFCC": "mfcc", "Shimmer": "shimmer", "Jitter": "jitter", "HNR / Harmonicity": "harmonicity", "Nonlinear": "nonlinear",
    "Intensity": "intensity", "Formant / Bandwidth": "formant_bandwidth", "Wavelet": "wavelet", "Other": "mixed_acoustic",
}


def category_phrase(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])[category], F.lit("mixed_acoustic"))


def assignment_table(labels: DataFrame, subjects: DataFrame, key: str, coordinates: DataFrame, scheme: str) -> DataFrame:
    """subjects with cluster, cluster_size, cluster_ratio, scheme and both coordinates: labels is (key, label), coordinates (key, pc1, pc2)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("cluster_size")).withColumn("cluster_ratio", F.col("cluster_size") / F.sum("cluster_size").over(Window.partitionBy()))
    out = subjects.join(labels, key).join(F.broadcast(sizes), "label").join(coordinates, key).withColumnRenamed("label", "cluster")
    return out.withColumn("scheme", F.lit(scheme)).select(*subjects.columns, "cluster", "cluster_size", "cluster_ratio", "scheme", "pc1", "pc2")


def category_counts(ranked: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """(category, n): of the first n features in an order, how many each category has."""
    return ranked.orderBy(*order).limit(n).groupBy("category").agg(F.count("*").alias("n"))


def joined_names(names: Column, order: Column) -> Column:
    """An aggregate: the names in order, joined by '; '."""
    listed = F.sort_array(F.collect_list(F.when(names.isNotNull(), F.struct(order.alias("o"), names.cast("string").alias("s")))))
    return F.array_join(F.transform(listed, lambda x: x["s"]), "; ")


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, text): how often each value occurs in a group, as value:count in order of the values."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    text = F.concat_ws(":", F.col(value).cast("string"), F.col("n").cast("string"))
    return counts.groupBy(by).agg(joined_names(text, F.col(value)).alias(f"{value}_distribution"))


def cluster_profiles(members: DataFrame, tops: DataFrame, label: str, described: list[str], *, prefix: str = "latent_phenotype", n: int = 5) -> DataFrame:
    """(label, n_members, ratio, dominant_categories, top_positive, top_negative, *_distribution, phenotype): a row for each cluster.

    members has label and the described columns; tops (label, feature, category, contrast) a cluster's features with its difference from the
    others. Categories come by count, then name. The n largest positive contrasts and the n most negative are listed, or
    the n nearest to that if a side is empty; phenotype joins the prefix, a letter, the dominant category and high or low: which side
    has the larger mean."""
    sizes = members.groupBy(label).agg(F.count("*").alias("n_members")).withColumn("ratio", F.col("n_members") / F.sum("n_members").over(Window.partitionBy()))
    w = Window.partitionBy(label)
    size = F.round(F.abs("contrast"), 9)
    up, down = F.col("contrast") >= 0, F.col("contrast") < 0
    ranked = tops.withColumns(
        {
            "_ups": F.count_if(up).over(w), "_downs": F.count_if(down).over(w),
            "_by_up": F.row_number().over(w.orderBy(F.desc("contrast"), "feature")), "_by_down": F.row_number().over(w.orderBy("contrast", "feature")),
            "_up": F.row_number().over(w.orderBy(F.desc(up), F.desc(size), "feature")), "_down": F.row_number().over(w.orderBy(F.desc(down), F.desc(size), "feature")),
        }
    )
    ranked = ranked.withColumns(
        {
            "_pos": F.when(F.col("_ups") > 0, F.when(up & (F.col("_up") <= n), F.col("_up"))).otherwise(F.when(F.col("_by_up") <= n, F.col("_by_up"))),
            "_neg": F.when(F.col("_downs") > 0, F.when(down & (F.col("_down") <= n), F.col("_down"))).otherwise(F.when(F.col("_by_down") <= n, F.col("_by_down"))),
        }
    )
    in_pos, in_neg = F.col("_pos").isNotNull(), F.col("_neg").isNotNull()
    sides = ranked.groupBy(label).agg(
        joined_names(F.when(in_pos, F.col("feature")), F.col("_pos")).alias("top_positive"), joined_names(F.when(in_neg, F.col("feature")), F.col("_neg")).alias("top_negative"),
        F.avg(F.when(in_pos, F.col("contrast"))).alias("_high"), F.avg(F.when(in_neg, F.col("contrast"))).alias("_low"),
    )
    counts = tops.groupBy(label, "category").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "category")
    kinds = counts.groupBy(label).agg(joined_names(F.concat_ws(":", "category", F.col("n").cast("string")), order).alias("dominant_categories"), F.min(order)["category"].alias("_kind"))
    out = sizes.join(kinds, label, "left").join(sides, label, "left")
    for column in described:
        out = out.join(distribution(members, label, column), label, "left")
    word = F.when(F.round("_high", 9) >= F.round(F.abs("_low"), 9), "high").otherwise("low")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col(label).cast("int") + 1, F.lit(1))
    phenotype = F.concat_ws("_", F.lit(prefix), letter, category_phrase(F.coalesce("_kind", F.lit("Other"))), word)
    return out.withColumn("phenotype", phenotype).drop("_kind", "_high", "_low")
