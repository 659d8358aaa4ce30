"""Evidence ranked and flagged, with optional ones absent, and grouped folds against the plain greedy rule."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import describe, metrics
from sparkloom.operators.evidence import evidence_summary


def average(values, descending):
    """Average ranks, missing last."""
    key = [np.inf if v is None else (-v if descending else v) for v in values]
    return [sum(k < x for k in key) + (sum(k == x for k in key) + 1) / 2 for x in key]


def test_evidence_summary(spark):
    rng = np.random.default_rng(2)
    n = 30
    names = [f"f{i:02d}" for i in range(n)]
    pick = lambda: [None if rng.random() < 0.1 else round(float(rng.integers(0, 8)) / 8, 3) for _ in range(n)]
    q, d, delta, often, fall, tree, gain = (pick() for _ in range(7))
    tests = spark.createDataFrame([*zip(names, q, d, delta)], "feature string, q_mannwhitney double, abs_cohens_d double, abs_cliffs_delta double")
    audit = spark.createDataFrame([(f, False, i % 3 == 0) for i, f in enumerate(names)], "feature string, is_constant boolean, is_near_constant boolean")
    l1 = spark.createDataFrame([(f, None if v is None else int(v * 5), v, 0.1) for f, v in zip(names, often)][:-2], "feature string, selected int, frequency double, mean_abs double")
    often = often[:-2] + [None, None]
    table = lambda values: spark.createDataFrame([(f, v, 0.5) for f, v in zip(names, values)], "feature string, mean double, std double")
    got = {r["feature"]: r for r in evidence_summary(tests, audit, l1, table(tree), table(fall), tops=(5, 10)).collect()}
    ranks = np.array([average(q, False), average(d, True), average(delta, True), average(often, True), average(fall, True), average(tree, True)]).T
    mean = ranks.mean(axis=1)
    order = sorted(range(n), key=lambda i: (round(mean[i], 9), names[i]))
    for i, f in enumerate(names):
        r, place = got[f], order.index(i) + 1
        assert (r["rank_q_mannwhitney"], r["rank_abs_cohens_d"], r["rank_abs_cliffs_delta"], r["rank_selection_frequency"], r["rank_permutation_importance_mean"], r["rank_tree_importance_mean"]) == tuple(ranks[i])
        assert r["mean_rank"] == pytest.approx(mean[i]) and r["rank_score"] == pytest.approx(1 / mean[i]) and r["place"] == place
        assert r["l1_selected_any"] == bool(often[i] and int(often[i] * 5) > 0) and r["permutation_importance_positive"] == bool(fall[i])
        assert r["l1_selected_near_constant"] == (r["l1_selected_any"] and i % 3 == 0)
        assert (r["included_in_top5"], r["included_in_top10"], r["top_near_constant"]) == (place <= 5, place <= 10, place <= 10 and i % 3 == 0)
        assert "shap_mean_abs_mean" not in r and "rank_boosted_importance" not in r
    more = {r["feature"]: r for r in evidence_summary(tests, audit, l1, table(tree), table(fall), boosted=table(gain), shap=table(gain)).collect()}
    want = average(gain, True)
    for i, f in enumerate(names):
        assert more[f]["rank_boosted_importance"] == want[i] == more[f]["rank_shap_mean_abs"]
        assert more[f]["mean_rank"] == pytest.approx(mean[i])  # optional evidence has no part in it


def greedy(subjects, k):
    """Counts of classes by fold when the subjects of each kind go round and the rest to where the spread is least."""
    kinds = {}
    for v in subjects.values():
        kinds[v] = kinds.get(v, 0) + 1
    total = np.maximum(sum((n * np.array(v) for v, n in kinds.items())), 1)
    held = np.array([sum(((n // k) * np.array(v) for v, n in kinds.items()), np.zeros(len(total)))] * k, float)
    for v in sorted(kinds, key=lambda v: (-np.std(v), json.dumps([{"_y": str(c), "_n": n} for c, n in enumerate(v) if n], separators=(",", ":")))):
        free = list(range(k))
        for _ in range(kinds[v] % k):
            def spread(f):
                new = held.copy()
                new[f] += v
                return np.std(new / total, axis=0).mean()

            f = min(free, key=lambda f: (round(spread(f), 12), held[f].sum(), f))
            held[f] += v
            free.remove(f)
    return sorted(map(tuple, held.astype(int).tolist()))


def test_grouped_folds_balance_records_of_each_class(spark):
    rng = np.random.default_rng(6)
    for n, k in ((30, 5), (200, 3), (12, 5)):
        subjects = {f"s{i}": tuple(int(x) for x in np.where([i % 3 > 0, i % 3 != 1], rng.integers(1, 9, 2), 0)) for i in range(n)}
        rows = [(s, c) for s, v in subjects.items() for c, m in enumerate(v) for _ in range(m)]
        records = spark.createDataFrame(rows, "id string, y int").repartition(3)
        folds = metrics.group_folds(records, "id", "y", k)
        found = {r["id"]: r["fold"] for r in folds.collect()}
        assert set(found) == {s for s, v in subjects.items() if sum(v)} and set(found.values()) == set(range(k))
        held = np.zeros((k, 2), int)
        for s, f in found.items():
            held[f] += subjects[s]
        assert sorted(map(tuple, held.tolist())) == greedy({s: v for s, v in subjects.items() if sum(v)}, k)
        if n > 50:
            assert np.ptp(held / held.sum(axis=0), axis=0).max() < 0.02
        again = {r["id"]: r["fold"] for r in metrics.group_folds(records.repartition(5), "id", "y", k).collect()}
        assert again == found
    plain = metrics.group_folds(records, "id", "y", k, stratified=False).join(records, "id").groupBy("fold").count().collect()
    assert np.ptp([r["count"] for r in plain]) <= max(sum(v) for v in subjects.values())
    odd = spark.createDataFrame([("a", None), ("a", 1), (None, 0), ("b", 0)], "id string, y int")
    assert metrics.group_folds(odd, "id", "y", 2).count() == 2 and metrics.group_folds(odd.limit(0), "id", "y", 2).count() == 0


def test_feature_zscores(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("a", None), ("c", None)]
    got = describe.feature_zscores(spark.createDataFrame(rows, "feature string, x double").withColumn("k", F.lit(1)))
    assert sorted((r["feature"], -9 if r["z"] is None else r["z"]) for r in got.collect()) == [("a", -9), ("a", -1), ("a", 1), ("b", 0), ("b", 0), ("c", -9)]
