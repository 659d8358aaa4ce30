"""Operators on small fixtures with known answers: ties, missing values, constant columns, published figures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import tails
from sparkloom.functions.expressions import close, first_match, minmax, warnings
from sparkloom.operators import cluster, describe, metrics, partitions, ranking, selection, sparse_pca, stats
from sparkloom.sources import tables


def test_average_ranks_put_missing_last(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None), (5, float("nan")), (6, 2.0)], "k int, x double").withColumn("g", F.lit("g"))
    up = {r.k: r["rank"] for r in ranking.average_ranks(df, ["g"], "x").collect()}
    down = {r.k: r["rank"] for r in ranking.average_ranks(df, ["g"], "x", descending=True).collect()}
    assert up == {2: 1.0, 6: 2.0, 1: 3.5, 3: 3.5, 4: 5.5, 5: 5.5}
    assert down == {1: 1.5, 3: 1.5, 6: 3.0, 2: 4.0, 4: 5.5, 5: 5.5}


def test_ranks_do_not_depend_on_buckets(spark):
    df = spark.range(3000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 97).cast("double").alias("x"))
    few, many = (sorted(map(tuple, ranking.cumulative_counts(df, ["g"], "x", buckets=b).select("x", "n", "before", "total").collect())) for b in (2, 50))
    assert few == many and few[1][2] == few[0][1]


def test_quantiles_interpolate(spark):
    xs = [5.0, 1.0, 2.0, 2.0, 9.0, 4.0, 7.5]
    df = spark.createDataFrame([("g", x) for x in xs], "g string, x double")
    r = ranking.quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(xs, [0.25, 0.5, 0.9])))


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.5, None, float("nan")]
    out = {r.i: r.q for r in ranking.adjust_fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q").collect()}
    assert [out[i] for i in range(5)] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5]) and out[5] is None and out[6] is None


def test_agreement_of_published_crosswalk(spark):
    same = spark.createDataFrame([(0, 5, 10), (1, 7, 4)], "a int, b int, n long")
    r = partitions.agreement(same).first()
    assert (r.n, r.ari, r.nmi) == (14, 1.0, 1.0)
    apart = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5)], "a int, b int, n long")
    r = partitions.agreement(apart).first()
    assert r.ari == pytest.approx(-1 / 18, abs=1e-6) and r.nmi == pytest.approx(0, abs=1e-12)


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.chi2_upper(11.0704976935, 5) == pytest.approx(0.05, rel=1e-6) and tails.chi2_upper(0, 5) == 1
    assert tails.t_two_sided(2.2281388520, 10) == pytest.approx(0.05, rel=1e-6) and tails.t_two_sided(0, 3) == pytest.approx(1)
    assert tails.t_two_sided(63.6567411629, 1) == pytest.approx(0.01, rel=1e-6)


def test_rank_test_by_pairs(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    long = spark.createDataFrame([("f", x, 1) for x in a] + [("f", x, 0) for x in b] + [("const", 1.0, i % 2) for i in range(6)], "feature string, x double, y int")
    out = {r.feature: r for r in stats.mann_whitney(long, F.col("y") == 1).collect()}
    u = sum((x > z) + 0.5 * (x == z) for x in a for z in b)
    assert out["f"].u == u and out["f"].cliffs_delta == pytest.approx(2 * u / 12 - 1) and 0 < out["f"].p <= 1
    assert out["const"].z is None and out["const"].p is None
    d = {r.feature: r.cohens_d for r in stats.cohens_d(long, F.col("y") == 1).collect()}
    assert d["const"] == 0 and d["f"] == pytest.approx((np.mean(a) - 3) / math.sqrt((3 * np.var(a, ddof=1) + 2 * 1) / 5))


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 1, 1), (3, 1, None), (3, 1, 1)], "id int, rec int, y int")
    assert tuple(describe.conflicts(df, "id", "y").first()) == (3, 2)
    assert tuple(describe.duplicates(df.union(df.limit(1)), df.columns).first()) == (7, 6, 1)
    assert {r["column"]: r.n_missing for r in describe.null_census(df).collect()} == {"id": 0, "rec": 0, "y": 1}
    table = {r.rec: (r["0"], r["1"], r.All) for r in describe.crosstab(df, "rec", "y", [0, 1], margins=True).collect()}
    assert table == {"1": (2, 2, 5), "2": (1, 0, 1), "All": (3, 2, 6)}


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0, "f1"), (3.0, 2.0, "mean_MFCC_delta"), (None, 2.0, "x")], "a double, b double, name string")
    out = df.select(minmax(F.col("a")).alias("a"), minmax(F.col("b")).alias("b"), first_match(F.col("name")).alias("c"), warnings((F.col("a") > 2, "high"), (F.col("b") > 1, "b")).alias("w"), close(F.col("a"), F.lit(1.0)).alias("k")).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.5, "Formant / Bandwidth", "b", True), (1.0, 0.5, "MFCC", "high; b", False), (0.0, 0.5, "Other", "b", False)]


def test_near_tie_overrides(spark):
    rows = [(1, "all", 1.0), (2, "top50", 0.95), (3, "top20", 0.90), (4, "top20", 0.93)]

    def pick(rows, choose):
        df = spark.createDataFrame([(*r, True) for r in rows], "id int, feature_set string, score double, eligible boolean")
        return choose(df).where("recommended").first().id

    assert pick(rows, selection.choose_2) == 2  # no top20 within 0.03, and the best has all features
    assert pick([(1, "all", 1.0), (2, "top50", 0.99), (3, "top20", 0.98)], selection.choose_2) == 3
    assert pick([(1, "all", 1.0), (2, "top50", 0.93), (3, "top20", 0.95)], selection.choose_6) == 2
    assert pick([(1, "all", 1.0), (2, "top50", 0.80)], selection.choose_6) == 1


def test_feature_components_are_strict(spark):
    names = spark.createDataFrame([(c,) for c in "abcde"], "feature string")
    links = spark.createDataFrame([("a", "b", 0.91), ("b", "c", 0.95), ("c", "d", 0.9), ("d", "e", None)], "i string, j string, r double")
    out = {r.feature: r.component for r in selection.feature_components(names, links, 0.9).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_silhouette_and_folds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) + np.repeat([[0, 0, 0], [4, 0, 0], [0, 4, 0]], 20, axis=0)
    y = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(60)], "id long, l int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(60):
        a = d[i, y == y[i]].sum() / 19
        b = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        want[i] = (b - a) / max(a, b)
    got = {r.id: r.s for r in metrics.silhouette(df, "id", "l", "v", block=16).collect()}
    assert got == pytest.approx(want)
    folds = metrics.stratified_folds(df.select("id", "l"), "id", "l").groupBy("l", "fold").count().collect()
    assert len(folds) == 15 and all(r["count"] == 4 for r in folds)


def test_sparse_components_are_sparse_and_of_length_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    x[:, 1] = x[:, 0] + 0.1 * rng.normal(size=200)
    data = cluster.standardised(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vector array<double>"))
    v = np.array([r.loading for r in sparse_pca.sparse_components(data, 2, alpha=8.0).where("component = 0").orderBy("feature").collect()])
    assert np.linalg.norm(v) == pytest.approx(1) and (abs(v) > 1e-9).sum() == 2 and abs(v[0] * v[1]) == pytest.approx(0.5, abs=0.05)


def test_banner_csv(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "banner.csv").write_text("﻿ Group A,,\nid,x,name\n1,2.5,a\n2,,b\n", encoding="utf-8")
    (tmp_path / "in" / "deep" / "plain.csv").write_text("id,x\n1,2.0\n")
    out = tables.read_csv(spark, str(tmp_path / "in" / "banner.csv"), "id int, x double, name string", banner=True)
    assert sorted(map(tuple, out.collect())) == [(1, 2.5, "a"), (2, None, "b")]
    assert tables.read_found(spark, str(tmp_path / "in"), "plain.csv", "id int, x double").count() == 1
    assert tables.markdown_table(spark.createDataFrame([(1, 0.5, "a|b")], "i int, x double, s string")) == "| i | x | s |\n| --- | --- | --- |\n| 1 | 0.5000 | a\\|b |"


@pytest.mark.parametrize("block", [1000, 21, 12])
def test_silhouette_looks_at_each_pair_of_blocks_once(spark, monkeypatch, block):
    """60 points in 1, 3 and 5 blocks; the least even number of blocks beyond one is tested below."""
    _silhouettes(spark, monkeypatch, block)


def test_silhouette_of_even_numbers_of_blocks(spark, monkeypatch):
    _silhouettes(spark, monkeypatch, 30)
    _silhouettes(spark, monkeypatch, 15)


def _silhouettes(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    x, label = rng.normal(size=(60, 3)), np.r_[rng.integers(0, 3, 59), 7]
    x[5] = x[6]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, l int, v array<double>")
    met, plain = [], type(df).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, *a, **b: met.append(self.count()) or plain(self, *a, **b))
        got = {r.id: r.s for r in metrics.silhouette(df, "id", "l", "v", block=block).collect()}
    n = -(-60 // block)
    assert met[0] <= n * (n + 1) // 2
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i in range(60):
        own = (label == label[i]).sum()
        a, b = d[i, label == label[i]].sum() / max(own - 1, 1), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        assert got[i] == pytest.approx(0 if own == 1 else (b - a) / max(a, b), abs=1e-6)


def test_distinct_values_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """However few partitions a shuffle has, a task gets about PART distinct values; the session's settings stay."""
    long = spark.range(400).selectExpr("id % 2 as feature", "cast(id * 7 % 397 as double) as x")
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before, want, files = [spark.conf.get(k) for k in keys], sorted(describe.describe(long, ["feature"]).collect()), []

    def kept(df, name, stored=ranking.stored):
        out = stored(df, name)
        files.extend([len(out.inputFiles())] * (name == "distinct-values"))
        return out

    monkeypatch.setattr(ranking, "stored", kept)
    monkeypatch.setattr(ranking, "PART", 10)
    assert sorted(describe.describe(long, ["feature"]).collect()) == want
    assert len(files) == 1 and files[0] > int(before[0])
    assert [spark.conf.get(k) for k in keys] == before
