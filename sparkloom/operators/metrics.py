"""Classifier metrics, folds and internal quality of clusterings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import share
from sparkloom.operators.ranking import average_rank, cumulative_counts
from sparkloom.sources.shared import few, stored

_STRIP = 256  # rows of a block whose distances from another are in memory at once

def confusion(df: DataFrame, by: list[str], y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(*by, n, tn, fp, fn, tp) of a binary score."""
    hit, true = F.col(score) >= threshold, F.col(y) == 1
    cells = {"tn": ~true & ~hit, "fp": ~true & hit, "fn": true & ~hit, "tp": true & hit}
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in cells.items()])


def binary_metrics(cells: DataFrame) -> DataFrame:
    """cells with accuracy, balanced_accuracy, sensitivity, specificity, precision and f1.

    Without rows of a class its share of hits, sensitivity or specificity, is missing (null), which fold_summary skips, and balanced
    accuracy is that of the other class. Precision and f1 are 0 for 0 / 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(share(a, b), F.lit(0.0))
    out = cells.withColumns({"accuracy": ratio(tp + tn, F.col("n")), "sensitivity": share(tp, tp + fn), "specificity": share(tn, tn + fp), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    both = F.array_compact(F.array("sensitivity", "specificity"))
    return out.withColumn("balanced_accuracy", F.aggregate(both, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(both), F.lit(0)))


def auc(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """(*by, auc): exact and aware of ties, by average ranks; null with one class only."""
    counted = cumulative_counts(df, by, score, {"_n1": (F.col(y) == 1).cast("long")})
    sums = counted.groupBy(*by).agg(F.sum("_n1").cast("double").alias("_p"), F.sum("n").cast("double").alias("_n"), F.sum(F.col("_n1") * average_rank()).alias("_r"))
    p, q = F.col("_p"), F.col("_n") - F.col("_p")
    return sums.select(*by, ((F.col("_r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))).alias("auc"))


def subject_scores(records: DataFrame, key: str, y: str, score: str) -> DataFrame:
    """(key, y, score): each subject's label and mean score."""
    return records.groupBy(key).agg(F.min(y).alias(y), F.avg(score).alias(score), F.count("*").alias("records"))


def fold_summary(df: DataFrame, by: list[str], metrics: list[str], *, sample: bool = True) -> DataFrame:
    """(*by, metric, mean, std) over folds, missing values skipped; std with n - 1 degrees of freedom if sample."""
    long = df.select(*by, *metrics).unpivot(by, metrics, "metric", "v") if by else df.select(*metrics).unpivot([], metrics, "metric", "v")
    v = F.when(~F.isnan("v"), F.col("v"))
    return long.groupBy(*by, "metric").agg(F.avg(v).alias("mean"), (F.stddev_samp(v) if sample else F.stddev_pop(v)).alias("std"))


def confusion_long(df: DataFrame, y: str, predicted: str, labels: list[int], by: list[str] | None = None) -> DataFrame:
    """(*by, true, predicted, n): all label pairs of each group, zero cells included."""
    by = by or []
    pairs = F.array(*[F.struct(F.lit(a).alias("true"), F.lit(b).alias("predicted")) for a in labels for b in labels])
    cells = df.groupBy(*by, F.col(y).cast("int").alias("true"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    groups = cells.select(*by).distinct() if by else df.sparkSession.range(1)
    zeros = groups.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*", F.lit(0).cast("long").alias("n"))
    return cells.unionByName(zeros).groupBy(*by, "true", "predicted").agg(F.sum("n").alias("n"))


def multiclass_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, accuracy, balanced_accuracy, f1_macro, f1_weighted, precision_macro, recall_macro) of a long confusion table.

    Groups are judged apart. Classes that are neither true nor predicted anywhere do not count; 0 / 0 gives 0."""
    sides = F.array(F.struct(F.col("true").alias("c"), F.lit(1).alias("is_true"), F.lit(0).alias("is_predicted")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("is_true"), F.lit(1).alias("is_predicted")))
    by = by or []
    rows = cells.select(*by, "n", (F.col("true") == F.col("predicted")).alias("same"), F.explode(sides).alias("s")).select(*by, "n", "same", "s.*")
    n = F.col("n")
    per = rows.groupBy(*by, "c").agg(F.sum(n * F.col("is_true")).alias("support"), F.sum(n * F.col("is_predicted")).alias("called"), F.sum(F.when(F.col("same"), n * F.col("is_true")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.coalesce(share(a, b), F.lit(0.0))
    per = per.where("support + called > 0").withColumns({"recall": ratio(F.col("hits"), F.col("support")), "precision": ratio(F.col("hits"), F.col("called")), "f1": ratio(2 * F.col("hits"), F.col("support") + F.col("called"))})
    return per.groupBy(*by).agg(
        share(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        share(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def stratified_folds(subjects: DataFrame, key: str, y: str, k: int = 5, seed: int = 42) -> DataFrame:
    """subjects with fold 0..k-1: each class is dealt round in the order of its keys' hashes. One row a subject; all records of
    a subject take its fold by join, so no subject is on both sides of a split."""
    h = F.xxhash64(F.lit(seed), key)
    counted = subjects.withColumn("_h", h)
    ranked = cumulative_counts(counted, [y], "_h").select(y, "_h", F.pmod(F.col("before"), F.lit(k)).cast("int").alias("fold"))
    return counted.join(ranked, [y, "_h"]).drop("_h")


def group_folds(records: DataFrame, key: str, y: str, k: int = 5, seed: int = 42, *, stratified: bool = True) -> DataFrame:
    """(key, fold): each subject's fold 0..k-1, such that folds have about the same number of records of each class although subjects have
    unlike numbers of them. Without stratified, classes do not count, only records.

    Subjects with the same numbers of records by class are alike. They are dealt round in the order of their keys' hashes; those left
    over go, the most uneven numbers first, each to the fold where the shares of the classes by fold then spread least, of equals
    to the one with fewest records. Only the distinct numbers, not subjects, reach the driver. Records without a class count as a class, those
    without a key get no fold."""
    label = F.coalesce(F.col(y).cast("string"), F.lit("")) if stratified else F.lit("")
    counts = records.where(F.col(key).isNotNull()).groupBy(key, label.alias("_y")).agg(F.count("*").alias("_n"))
    subjects = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_y", "_n"))).alias("_v"))
    subjects = stored(subjects.withColumn("_v", F.to_json("_v")).withColumn("_h", F.xxhash64(F.lit(seed), key)), "subject-counts")
    dealt = cumulative_counts(subjects, ["_v"], "_h").select("_v", "_h", "before", "total")
    kinds = {r["_v"]: r["n"] for r in subjects.groupBy("_v").agg(F.count("*").alias("n")).collect()}
    vectors = {v: {x["_y"]: x["_n"] for x in json.loads(v)} for v in kinds}
    labels = sorted({c for v in vectors.values() for c in v})
    numbers = {v: np.array([d.get(c, 0) for c in labels], float) for v, d in vectors.items()}
    total = np.maximum(sum((n * numbers[v] for v, n in kinds.items()), np.zeros(len(labels))), 1)
    held = np.tile(sum(((n // k) * numbers[v] for v, n in kinds.items()), np.zeros(len(labels))), (k, 1))
    places = []
    for v in sorted(kinds, key=lambda v: (-numbers[v].std() if len(labels) > 1 else -numbers[v].sum(), v)):
        free = list(range(k))
        for i in range(kinds[v] % k):
            spread = [np.std((held + np.eye(k)[f][:, None] * numbers[v]) / total, axis=0).mean() for f in free]
            f = min(range(len(free)), key=lambda i: (round(spread[i], 12), held[free[i]].sum(), free[i]))
            held[free[f]] += numbers[v]
            places.append((v, i, free.pop(f)))
    left = records.sparkSession.createDataFrame(places, "_v string, _i long, _f int")
    whole = F.col("before") < F.col("total") - F.pmod("total", F.lit(k))
    at = dealt.withColumn("_i", F.when(~whole, F.col("before") - F.col("total") + F.pmod("total", F.lit(k))))
    at = at.join(few(left, 1_000_000), ["_v", "_i"], "left").withColumn("fold", F.coalesce("_f", F.pmod("before", F.lit(k)).cast("int")))
    return subjects.join(at.select("_v", "_h", "fold"), ["_v", "_h"]).select(key, "fold")


def fold_audit(records: DataFrame, key: str, y: str, k: int = 5) -> DataFrame:
    """(fold, train_subjects, test_subjects, train_records, test_records, test_positive, overlap) from records with a fold."""
    per = records.groupBy(key).agg(F.min(y).alias("y"), F.count("*").alias("records"), F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    rows = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    test = (F.col("lo") <= F.col("fold")) & (F.col("fold") <= F.col("hi"))
    train = (F.col("lo") != F.col("fold")) | (F.col("hi") != F.col("fold"))
    return rows.groupBy("fold").agg(
        F.count_if(train).alias("train_subjects"),
        F.count_if(test).alias("test_subjects"),
        F.sum(F.when(~test, F.col("records")).otherwise(0)).alias("train_records"),
        F.sum(F.when(test, F.col("records")).otherwise(0)).alias("test_records"),
        F.count_if(test & (F.col("y") == 1)).alias("test_positive"),
        F.count_if(train & test).alias("overlap"),
    )


def centroid_quality(long: DataFrame, point: str, label: str) -> DataFrame:
    """(calinski_harabasz, davies_bouldin) of a partition, from sums by cluster and feature; null with one cluster."""
    w = Window.partitionBy("feature")
    cells = long.groupBy(label, "feature").agg(F.count("*").alias("n"), F.avg("x").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    cells = cells.withColumn("m", F.sum("s").over(w) / F.sum("n").over(w))
    per = cells.groupBy(label).agg(F.max("n").alias("n"), F.sum(F.col("ss") - F.col("n") * F.col("c") * F.col("c")).alias("within"), F.sum(F.col("n") * (F.col("c") - F.col("m")) * (F.col("c") - F.col("m"))).alias("between"))
    total = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"), F.sum("between").alias("b"))
    ch = total.select("k", (F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)) / F.nullif(F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))).alias("calinski_harabasz"))
    centres = cells.select(F.col(label).alias("label"), "feature", "c")
    gap = F.col("x") - F.col("c")
    spread = long.join(centres.withColumnRenamed("label", label), [label, "feature"]).groupBy(point, F.col(label).alias("label")).agg(F.sqrt(F.sum(gap * gap)).alias("d")).groupBy("label").agg(F.avg("d").alias("s"))
    a, b = centres.alias("a"), centres.alias("b")
    step = F.col("a.c") - F.col("b.c")
    apart = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.label") != F.col("b.label"))).groupBy(F.col("a.label").alias("i"), F.col("b.label").alias("j")).agg(F.sqrt(F.sum(step * step)).alias("gap"))
    worst = apart.join(spread.select(F.col("label").alias("i"), F.col("s").alias("si")), "i").join(spread.select(F.col("label").alias("j"), F.col("s").alias("sj")), "j")
    db = worst.groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.nullif(F.col("gap"), F.lit(0.0))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.crossJoin(db).select("calinski_harabasz", "davies_bouldin")


def silhouette(points: DataFrame, point: str, label: str, vector: str, *, block: int = 16_384) -> DataFrame:
    """(point, label, s): the Euclidean silhouette of each point.

    Exact, so every point meets every other: points go into blocks by hash, and a task takes a pair of blocks, whose distances it
    looks at a few rows at a time and only once for both. A block is sent to half of all others; only sums of distances by point and
    cluster leave a task."""
    rows = points.select(F.col(point).cast("long").alias("p"), F.col(label).cast("int").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    rows = stored(rows, "silhouette-points")
    count = max(1, -(-rows.count() // block))
    packed = rows.groupBy(F.pmod(F.xxhash64("p"), F.lit(count)).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct("l", "p", "v"))).alias("r"))
    packed = stored(packed.select("b", F.col("r.p").alias("p"), F.col("r.l").alias("l"), F.flatten("r.v").alias("v")), "silhouette-blocks")
    # Block i meets those up to half way round from it; of an even number, the one just opposite only once.
    steps = F.sequence(F.lit(0), F.when(F.lit(count % 2 == 0) & (F.col("b") >= count // 2), count // 2 - 1).otherwise(count // 2))
    left = packed.select(F.col("b").alias("i"), F.explode(F.transform(steps, lambda d: F.pmod(F.col("b") + d, F.lit(count)))).alias("j"), *[F.col(c).alias(f"{c}x") for c in "plv"])
    back = F.sequence(F.lit(0), F.lit(count // 2))
    right = packed.select(F.col("b").alias("j"), F.explode(F.transform(back, lambda d: F.pmod(F.col("b") - d, F.lit(count)))).alias("i"), *[F.col(c).alias(f"{c}y") for c in "plv"])
    pairs = left.join(right, ["i", "j"]).select((F.col("i") == F.col("j")).alias("same"), *[f"{c}{side}" for side in "xy" for c in "plv"])

    def sums_of(p: np.ndarray, l: np.ndarray, c: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """d and n, by point and cluster, as rows."""
        shape = (len(p), len(c))
        columns = [np.repeat(p, shape[1]), np.repeat(l, shape[1]), np.tile(c, shape[0]), d.ravel(), np.broadcast_to(n, shape).ravel()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["p", "l", "c", "d", "n"])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (p, l, x), (q, m, y) = ([batch.column(f"{c}{side}")[k].values.to_numpy(zero_copy_only=False) for c in "plv"] for side in "xy")
                same, x, y = batch.column("same")[k].as_py(), x.reshape(len(p), -1), y.reshape(len(q), -1)
                xx, yy = (x * x).sum(1), (y * y).sum(1)
                firsts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                n = np.diff(np.r_[firsts, len(m)])
                runs = np.flatnonzero(np.r_[True, l[1:] != l[:-1], True])
                for start, end in zip(runs[:-1], runs[1:]):
                    total = np.zeros(len(q))
                    for i in range(start, end, _STRIP):
                        own = slice(i, min(i + _STRIP, end))
                        d = x[own] @ y.T
                        d *= -2
                        d += xx[own, None]
                        d += yy
                        np.sqrt(np.maximum(d, 0, out=d), out=d)
                        if same:
                            d[p[own, None] == q] = 0
                        else:
                            total += d.sum(0)
                        yield sums_of(p[own], l[own], m[firsts], np.add.reduceat(d, firsts, axis=1), n)
                    if not same:
                        yield sums_of(q, m, l[start : start + 1], total[:, None], np.array([end - start]))

    sums = pairs.mapInArrow(distances, "p long, l int, c int, d double, n long").groupBy("p", "l", "c").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("l") == F.col("c")
    per = sums.groupBy("p", "l").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("d") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return per.select(F.col("p").alias(point), F.col("l").alias(label), s.alias("s"))


def one_vs_rest(df: DataFrame, label: str, classes: list[int], score: Column) -> DataFrame:
    """(class, y, score): each row once for each class, with whether it is of the class."""
    return df.select(F.explode(F.lit(classes)).alias("class"), "*").select("class", (F.col(label) == F.col("class")).cast("int").alias("y"), score.alias("score"))
