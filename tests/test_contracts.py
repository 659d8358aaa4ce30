"""Contracts, sources, reports and audits on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import audit, contracts, describe, metrics, ranking, reports, selection, stats
from sparkloom.sources import tables


def test_ranking_core_reads_once_and_never_deals_values_by_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("int").alias("feature"), (F.col("id") * 7919 % 997).cast("double").alias("x"))
    plan = ranking.cumulative_counts(df, ["feature"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature#" in plan and not any("hashpartitioning(feature#" in line and ", 8)" in line and "_part" not in line and line.count("#") < 3 for line in plan.split("\n"))
    plan = describe.median_deviation(df, ["feature"])._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # the source itself is read before, once


def test_missing_classes_and_nan(spark):
    cells = spark.createDataFrame([(0, 4, 3, 1, 0, 0), (1, 2, 1, 0, 0, 1)], "fold int, n int, tn int, fp int, fn int, tp int")
    out = {r.fold: r for r in metrics.binary_metrics(cells).collect()}
    assert out[0].sensitivity is None and out[0].balanced_accuracy == 0.75 and out[0].precision == 0 and out[1].balanced_accuracy == 1
    x = [1.0, 2.0, 4.0, 3.0, 5.0, 9.0]
    long = spark.createDataFrame([("f", v, i % 2) for i, v in enumerate(x)], "feature string, x double, y int")
    more = long.unionByName(spark.createDataFrame([("f", math.nan, 1), ("f", None, 0)], "feature string, x double, y int"))
    for test in (stats.mann_whitney, stats.welch, stats.cohens_d):
        assert [tuple(r) for r in test(long, F.col("y") == 1).collect()] == [tuple(r) for r in test(more, F.col("y") == 1).collect()]


def test_csv_below_a_banner(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Group A,,\nid,x,name\n1,2.5,"a, b"\n2,,"two\nlines"\n3,1.5,""\n,,\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"), "id int, x double, name string", banner=True).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 2.5, "a, b"), (2, None, "two\nlines"), (3, 1.5, None), (None, None, None)], key=str)
    (tmp_path / "b.csv").write_text("Group A\nid,x,name\n1,2.5,a\n1,2.5\n", encoding="utf-8")
    with pytest.raises(Exception, match="malformed"):
        tables.read_csv(spark, str(tmp_path / "b.csv"), "id int, x double, name string", banner=True).collect()
    with pytest.raises(ValueError, match="no header"):
        tables.read_csv(spark, str(tmp_path / "b.csv"), "id int, y double", banner=True)


def test_sinks_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "ä|b"), (2, None, "c\nd")], "i int, x double, s string")
    tables.write_csv(df, f"{tmp_path}/out.csv")
    assert (tmp_path / "out.csv").read_bytes().decode("utf-8") == '﻿i,x,s\n1,0.5,ä|b\n2,,"c\nd"\n'
    tables.write_crosstab(df.select("s", "i"), f"{tmp_path}/cross.csv", "s", "i")
    assert (tmp_path / "cross.csv").read_text("utf-8-sig").startswith("s\\i,i\n")
    tables.write_report(spark, f"{tmp_path}/r.md", "T", [("A", "text"), ("B", df)])
    assert "| 1 | 0.5000 | ä\\|b |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError, match="no report"):
        tables.markdown_table(df, max_rows=1)
    (tmp_path / "bad.txt").write_bytes(b"one\r\ntw\xffo")
    assert sorted((r.line_no, r.line) for r in tables.read_lines(spark, str(tmp_path), "bad.txt").collect()) == [(1, "one"), (2, "tw�o")]
    tables.require_files(spark, [f"{tmp_path}/r.md"])
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tables.require_files(spark, [f"{tmp_path}/r.md", f"{tmp_path}/nowhere"])
    assert tables.remove_outputs(spark, str(tmp_path), "*.csv") == ["cross.csv", "out.csv"] and not list(tmp_path.glob("*.csv"))


def test_contracts_fail_loudly(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0), (2, 0, 1.0, 1.0)], "id int, y int, f1 double, class_score double")
    assert contracts.allowed_features(df, ["id", "y"]) == ["f1"]
    with pytest.raises(ValueError, match="expected"):
        contracts.allowed_features(df, ["id", "y"], expected=2)
    assert contracts.cohort(df, "y", 1, expected=1, total=2).count() == 1
    with pytest.raises(ValueError, match="cohort is 1, not 3"):
        contracts.cohort(df, "y", 1, expected=3)
    with pytest.raises(ValueError, match="no match"):
        contracts.join_all(df, df.where("id = 1").select("id", F.col("f1").alias("g")), "id", ["g"])
    with pytest.raises(ValueError, match="repeated"):
        contracts.join_all(df, df.union(df).select("id", F.col("f1").alias("g")), "id", ["g"])
    assert tuple(contracts.set_relation(df, df.where("id = 1"), "id").first()) == (2, 1, 1, 1, 0, 2, False)


def test_cluster_profiles(spark):
    members = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, 1)], "c int, sex int")
    tops = [(0, "a", "MFCC", 0.5), (0, "b", "MFCC", -0.9), (0, "d", "TQWT", 0.2), (1, "a", "TQWT", -0.3), (1, "e", "HNR / Harmonicity", -0.1)]
    out = {r.c: r for r in reports.cluster_profiles(members, spark.createDataFrame(tops, "c int, feature string, category string, contrast double"), "c", ["sex"]).collect()}
    assert (out[0].n_members, out[0].ratio, out[0].dominant_categories, out[0].top_positive, out[0].top_negative) == (3, 0.75, "MFCC:2; TQWT:1", "a; d", "b")
    assert out[0].sex_distribution == "0:1; 1:2" and out[0].phenotype == "latent_phenotype_A_mfcc_low"
    assert out[1].top_positive == "e; a" and out[1].top_negative == "a; e" and out[1].phenotype == "latent_phenotype_B_harmonicity_low"


def test_feature_schemes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)) * [1, 2, 3, 4, 5, 6]
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=80) * 0.05
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    ranked = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, place int")
    out = selection.feature_schemes(df, names, ranked).persist()
    own = {s: [r.feature for r in out.where(F.col("scheme") == s).orderBy("place").collect()] for s in ("top20", "all", "corr_reduced_all_090", "high_iqr_top50")}
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25], axis=0))
    assert own["top20"] == own["all"] == names and own["corr_reduced_all_090"] == names[1:] and own["high_iqr_top50"] == [names[i] for i in np.argsort(-iqr)]
    audit_rows = {r.scheme: (r.n_features, r.representations, r.n_candidates) for r in selection.scheme_audit(out).collect()}
    assert len(audit_rows) == 12 and audit_rows["sparse_pca_10"] == (6, "sparse_pca_10", 3) and audit_rows["all"] == (6, "scaled_only; pca_5; pca_10", 9)


def test_static_scan(spark):
    lines = ["x = train_test_split(a)", "- No train_test_split here", "Pipeline([StandardScaler()])", "PCA(2)", "SMOTE()", "y = table[Status]", "audit", "plain"]
    df = spark.createDataFrame([("m.py", i + 1, x) for i, x in enumerate(lines)] + [("u.py", 1, "fit_transform(z)"), ("u.py", 5, "LogisticRegressionCV"), ("u.py", 9, "Pipeline")], "file string, line_no int, line string")
    out = {(r.file, r.line_no, r.keyword): (r.status, r.needs_fix) for r in audit.classify_static(df, supervised=["m.py"]).collect()}
    assert out["m.py", 1, "train_test_split"] == ("fail", "yes") and out["m.py", 2, "train_test_split"] == ("safe", "no")
    assert out["m.py", 3, "StandardScaler("][0] == "safe" and out["m.py", 4, "PCA("][0] == "safe" and out["m.py", 5, "SMOTE"][0] == "warning"
    assert out["m.py", 6, "Status"][0] == "safe" and out["u.py", 1, "fit_transform"][0] == "warning" and out["u.py", 5, "LogisticRegressionCV"][0] == "safe"


def test_number_formats(spark):
    df = spark.createDataFrame([(0.000123456, 0.25, 1234567.891, 7), (None, float("nan"), 1.0, None)], "p double, share double, x double, n int")
    got = tables.markdown_table(df, formats={"p": ".3e", "share": ".1%", "x": ".12g"}).split("\n")
    assert got[2:] == ["| 1.235e-04 | 25.0% | 1234567.891 | 7 |", "|  |  | 1 |  |"]


def test_static_scan_in_blocks(spark):
    import random

    rng = random.Random(3)
    pieces = ["x", "class", "y =", "audit", "LogisticRegressionCV", "Pipeline", "stage5_cluster", "train_test_split", "- No row-wise random"]
    lines = [(f, i, " ".join(rng.choices(pieces, k=rng.randint(0, 2)))) for f in ("a.py", "s.py") for i in range(1, 201)]
    df = spark.createDataFrame(lines, "file string, line_no int, line string").repartition(5)
    key = lambda r: (r["file"], r["line_no"], r["keyword"])
    whole = sorted(audit.classify_static(df, supervised=[], aligned=["s.py"]).collect(), key=key)
    for block in (12, 13, 50):
        assert sorted(audit.classify_static(df, supervised=[], aligned=["s.py"], block=block).collect(), key=key) == whole
    by_status = {(r["keyword"], r["status"]) for r in whole}
    assert {("stage5_cluster", "warning"), ("class", "warning"), ("class", "safe"), ("train_test_split", "fail"), ("LogisticRegressionCV", "warning"), ("LogisticRegressionCV", "safe")} <= by_status
    at = {(f, i): line for f, i, line in lines}
    for r in whole:
        near = "\n".join(at.get((r["file"], i), "") for i in range(r["line_no"] - 3, r["line_no"] + 4))
        far = "\n".join(at.get((r["file"], i), "") for i in range(r["line_no"] - 12, r["line_no"] + 13))
        if r["keyword"] == "LogisticRegressionCV":
            assert (r["status"] == "safe") == ("Pipeline" in far)
        if r["keyword"] == "class":
            assert (r["status"] == "warning") == ("y =" in near and "audit" not in near)
        assert r["explanation"]
