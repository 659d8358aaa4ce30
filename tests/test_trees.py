"""Boosted trees, Shapley values, extremely randomised trees and sparse components against brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import boosting as B
from sparkloom.operators import extra_trees as E
from sparkloom.operators import models
from sparkloom.operators import sparse_pca as S

SCHEMA = "id long, y int, vector array<double>"
SMALL = B.Options(rounds=12, rate=0.3, l2=1.0, bins=16)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 5))
    x[:, 2] = np.round(x[:, 2])
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (x[:, 2] > 1)).astype(int)
    return x, y, np.arange(240) % 3


@pytest.fixture(scope="module")
def rows(spark, points):
    x, y, fold = points
    data = spark.createDataFrame([(i, int(c), v.tolist(), int(f)) for i, (v, c, f) in enumerate(zip(x, y, fold))], SCHEMA + ", fold int")
    return data.repartition(4).persist()


@pytest.fixture(scope="module")
def trees(rows):
    return B.fit(rows, [0, 1, 2], SMALL, keep_every=5)


def brute_histograms(trees, r, level, m, held, codes, y, fold, draw, o):
    """The sums that one level of one model's tree needs, row by row."""
    nodes, out = 1 << level, np.zeros((1 << level, codes.shape[1], o.bins, 2))
    drawn = B._drawn(draw, o.rows, o.seed + 1000 * r + m)
    for i in range(len(codes)):
        if fold[i] == held or not drawn[i]:
            continue
        node = 0
        for _ in range(level):
            j = trees.feature[m, r, node]
            if j < 0:
                break
            node = 2 * node + 1 + int(codes[i, j] > trees.bin[m, r, node])
        if node < nodes - 1:
            continue
        margin = trees.base[m] + trees.margins(codes[i : i + 1], 0, r)[0, m]
        p = 1 / (1 + np.exp(-margin))
        for j in range(codes.shape[1]):
            out[node - nodes + 1, j, codes[i, j]] += p - y[i], p * (1 - p)
    return out


def test_each_split_has_the_largest_gain(rows, points, trees):
    x, y, fold = points
    draw = {r["id"]: r["d"] for r in rows.select("id", F.xxhash64("id").alias("d")).collect()}
    draw, codes, o = np.array([draw[i] for i in range(len(x))]), B._codes(x, trees.cuts), SMALL
    for m, r in ((0, 0), (1, 3), (2, 11)):
        columns = np.zeros((3, 5), bool)
        rng = np.random.default_rng((o.seed, r))
        for i in range(3):
            columns[i, rng.choice(5, 4, replace=False)] = True
        for level in (0, 1):
            sums = brute_histograms(trees, r, level, m, m, codes, y, fold, draw, o)
            for i in range(1 << level):
                node = (1 << level) - 1 + i
                if level and trees.feature[m, r, 0] < 0:
                    continue
                score = lambda g, h: max(abs(g) - o.l1, 0) ** 2 / (h + o.l2)
                best = 0.0
                for j in np.flatnonzero(columns[m]):
                    for b in range(o.bins - 1):
                        (gl, hl), (gr, hr) = sums[i, j, : b + 1].sum(0), sums[i, j, b + 1 :].sum(0)
                        if min(hl, hr) >= o.least_weight:
                            best = max(best, score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr))
                assert trees.gain[m, r, node] == pytest.approx(best, abs=1e-4)


def test_loss_falls_and_reruns_agree(rows, points, trees, monkeypatch):
    x, y, fold = points
    codes = B._codes(x, trees.cuts)
    for m in range(3):
        own, loss = fold != m, []
        for r in range(SMALL.rounds + 1):
            margin = trees.base[m] + trees.margins(codes, 0, r)[own, m]
            loss.append(np.mean(np.log1p(np.exp(-np.where(y[own] == 1, margin, -margin)))))
        assert loss[-1] < 0.6 * loss[0] and all(b <= a + 0.01 for a, b in zip(loss, loss[1:]))
    monkeypatch.setattr(B.binned, "__defaults__", (100,))  # three tasks, whose sums Spark adds up
    again = B.fit(rows.repartition(2), [0, 1, 2], SMALL, keep_every=100)
    assert (again.feature == trees.feature).all() and (again.bin == trees.bin).all() and np.allclose(again.value, trees.value)


def test_a_level_reads_blocks_and_sums_one_child_of_two(rows, points, trees, monkeypatch):
    x, y, fold = points
    table, parts = B.binned(rows, trees.cuts, 3)
    assert parts == 1 and table.count() == 1  # 240 rows, stored together
    seen, histograms = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: seen.append((a[4], histograms(*a))) or seen[-1][1])
    deep = B.fit(rows, [0, 1, 2], B.Options(rounds=1, depth=3, rows=1.0, bins=16))
    codes = B._codes(x, deep.cuts)
    for slots, sums in seen[1:]:
        for m, node in zip(*np.nonzero(slots >= 0)):
            sibling = node - 1 if node % 2 == 0 else node + 1
            assert slots[m, sibling] == -1 and deep.cover[m, 0, node] <= deep.cover[m, 0, sibling]
            own = (fold != m) & (deep._reached(codes.T, m, 0, np.arange(slots.shape[1])) == node)
            p = 1 / (1 + np.exp(-deep.base[m]))
            assert sums[m, slots[m, node], 0, :, 0].sum() == pytest.approx((p - y[own]).sum(), abs=1e-4)
    assert len(seen) == 3


def test_models_do_not_look_at_the_fold_they_hold(spark, rows, trees):
    other = rows.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    again = B.fit(other, [0, 1, 2], SMALL)
    assert (again.feature[1] == trees.feature[1]).all() and np.allclose(again.value[1], trees.value[1])
    assert not np.allclose(again.value[0], trees.value[0])


def test_shapley_values_are_those_of_all_subsets(rows, points, trees):
    x, _, _ = points
    codes = B._codes(x[:12], trees.cuts)

    def worth(m, row, known):
        def at(r, node):
            j = trees.feature[m, r, node]
            if j < 0:
                return trees.value[m, r, node]
            if j in known:
                return at(r, 2 * node + 1 + int(row[j] > trees.bin[m, r, node]))
            cover = trees.cover[m, r]
            return sum(cover[c] * at(r, c) for c in (2 * node + 1, 2 * node + 2)) / cover[node]

        return trees.base[m] + sum(at(r, 0) for r in range(SMALL.rounds))

    for m in range(3):
        found = B.contributions(trees, m, codes)
        assert np.allclose(found.sum(axis=1) + B.expected(trees, m), trees.base[m] + trees.margins(codes)[:, m], atol=1e-9)
        for i, row in enumerate(codes):
            assert worth(m, row, set()) == pytest.approx(B.expected(trees, m), abs=1e-9)
            for j in range(5):
                rest = [f for f in range(5) if f != j]
                want = sum(factorial(n) * factorial(4 - n) / factorial(5) * (worth(m, row, {*s, j}) - worth(m, row, set(s))) for n in range(5) for s in combinations(rest, n))
                assert found[i, j] == pytest.approx(want, abs=1e-9)


def test_shapley_values_of_deeper_trees_that_split_a_feature_twice(rows, points):
    deep = B.fit(rows, [-1], B.Options(rounds=2, depth=4, rate=0.5, rows=1.0, columns=1.0, l1=0.0, bins=16))
    assert any(len({*p}) < len(p) for p in [[f for f in deep.feature[0, r, [0, 1, 3, 7]] if f >= 0] for r in range(2)]) or (deep.feature[0, :, 7:15] >= 0).any()
    codes = B._codes(points[0], deep.cuts)
    assert np.allclose(B.contributions(deep, 0, codes).sum(axis=1) + B.expected(deep, 0), deep.base[0] + deep.margins(codes)[:, 0], atol=1e-9)


def test_boosting_tables(spark, rows, points, trees):
    scored = B.scores(rows, trees, [0, 1, 2])
    assert scored.count() == 240 and models.evaluate(scored).agg(F.avg("auc")).first()[0] > 0.85
    found = {r["id"]: r for r in B.shap_rows(rows, trees, [0, 1, 2]).collect()}
    assert len(found) == 240
    for r in scored.collect():
        assert sum(found[r["id"]]["contributions"]) + found[r["id"]]["base"] == pytest.approx(r["margin"], abs=1e-9)
    table = B.importance(rows, [0, 1, 2], SMALL).orderBy("feature").collect()
    assert [r["feature"] for r in table] == [0, 1, 2, 3, 4]
    assert {r["feature"] for r in table if r["rank_shap"] <= 3} == {0, 1, 2} and sum(r["gain_mean"] for r in table) == pytest.approx(1)


def test_boosting_odd_rows(spark, points):
    x, y, fold = points
    data = [(i, int(c), v.tolist(), int(f)) for i, (v, c, f) in enumerate(zip(x, y, fold))]
    odd = [(1, None, [0.0] * 5, 0), (7, 1, [None, float("nan"), 1.0, 2.0, 3.0], 1), (7, 1, [None, float("nan"), 1.0, 2.0, 3.0], 1)]
    table = spark.createDataFrame(data + odd, SCHEMA + ", fold int").withColumn("score", F.lit("x"))
    out = B.scores(table, B.fit(table, [0, 1], SMALL), [0, 1])
    assert out.count() == sum(f < 2 for f in fold) + 3 and out.where("score is null or isnan(score)").count() == 0
    with pytest.raises(ValueError, match="needs rows"):
        B.fit(table.limit(0), [0], SMALL)
    with pytest.raises(ValueError, match="one class"):
        B.fit(table.where("y = 1"), [0], SMALL)


@pytest.fixture(scope="module")
def forest(rows):
    return E.fit(rows, [0, 1, 2], trees=30)


def test_extra_trees_split_as_the_rule_says(points, forest):
    x, y, fold = points
    for t in (0, 29, 30, 65, 89):
        inside = {t: np.flatnonzero(fold != t // 30)}
        while inside:
            node, own = inside.popitem()
            assert (forest.n[node], forest.ones[node]) == (len(own), y[own].sum())
            j = forest.feature[node]
            if j < 0:
                assert y[own].min() == y[own].max() or (x[own] == x[own[0]]).all()
                continue
            v, cut = x[own, j], forest.cut[node]
            assert v.min() <= cut < v.max()
            tried = E._draw(np.array([node]), np.zeros(1, int), 5, 2, 42)[0]
            varied = [f for f in tried if x[own, f].min() < x[own, f].max()]
            if not varied:
                continue
            assert j in varied
            fall = {}
            for f in varied:
                u = E._mixed(np.full(1, 43), np.array([node]), np.array([f]))[0]
                low, high = x[own, f].min(), x[own, f].max()
                c = low * (1 - u) + high * u
                left = x[own, f] <= (c if c < high else low)
                p = lambda k: 2 * y[k].sum() * (len(k) - y[k].sum()) / max(len(k), 1)
                fall[f] = p(own) - p(own[left]) - p(own[~left])
            assert fall[j] == pytest.approx(max(fall.values()))
            inside[forest.left[node]], inside[forest.left[node] + 1] = own[v <= cut], own[v > cut]


def test_extra_trees_thresholds_are_uniform():
    u = E._mixed(np.full(1, 43), np.arange(20_000), np.zeros(1, int))
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005
    order = E._draw(np.arange(5000), np.zeros(5000, int), 5, 5, 42)
    assert (np.sort(order, axis=1) == np.arange(5)).all()
    assert np.abs(np.bincount(order[:, 0]) / 5000 - 0.2).max() < 0.03
    assert (E._draw(np.arange(3), np.ones(3, int), 5, 3, 42)[:, 2] == -1).all()


def test_extra_trees_importance(spark, rows, points, forest):
    share = E.importances(forest, 5)
    assert np.allclose(share.sum(axis=1), 1) and (share[:, :2].min(axis=1) > share[:, 2:].max(axis=1)).all()
    again = E.fit(rows.repartition(2), [0, 1, 2], trees=30)
    assert (again.feature == forest.feature).all() and np.allclose(again.cut, forest.cut)
    shallow = E.fit(rows, [0, -1], trees=3, depth=2)
    assert len(shallow.feature) <= 6 * 7
    with pytest.raises(ValueError, match="max_frontier"):
        E.fit(rows, [0], trees=3, max_frontier=2)
    swapped = models.permuted_rows(rows, 5)
    assert swapped.count() == 240 * 6
    x = points[0]
    for f in (-1, 3):
        got = sorted((r["fold"], *r["vector"]) for r in swapped.where(F.col("feature") == f).collect())
        keep = [i for i in range(5) if i != f]
        assert sorted(tuple(np.array(g)[[0, *(k + 1 for k in keep)]]) for g in got) == sorted((i % 3, *x[i, keep]) for i in range(240))
        assert sorted((g[0], g[4]) for g in got) == sorted((i % 3, x[i, 3]) for i in range(240))
    fall = {r["feature"]: r["mean"] for r in models.accuracy_fall(E.with_score(swapped, forest, [0, 1, 2])).collect()}
    assert set(fall) == set(range(5)) and fall[0] > 0.1 and fall[1] > 0.1 and abs(fall[3]) < 0.1


@pytest.fixture(scope="module")
def products():
    rng = np.random.default_rng(3)
    hidden = rng.normal(size=(300, 3))
    x = hidden @ np.array([[1.0, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 1]]) + 0.3 * rng.normal(size=(300, 8))
    x = (x - x.mean(0)) / x.std(0)
    return x, x.T @ x


def test_sparse_components_never_raise_the_objective_and_are_optimal(products):
    x, c = products
    for k, alpha in ((3, 1.0), (4, 4.0), (3, 8.0)):
        v, m, course = S.sparse_dictionary(c, k, alpha=alpha, rounds=400, tolerance=0.0)
        assert all(b <= a + 1e-8 * abs(a) for a, b in zip(course, course[1:]))
        u = x @ m
        assert course[-1] == pytest.approx(0.5 * ((x - u @ v) ** 2).sum() + alpha * np.abs(v).sum())
        assert (np.linalg.norm(u, axis=0) <= 1 + 1e-9).all()
        best = S.loadings(c, v, m, alpha, sweeps=5000, tolerance=1e-12)
        slope = u.T @ (u @ best - x)
        assert np.abs(slope[best > 0] + alpha).max(initial=0) < 1e-4 and np.abs(slope[best < 0] - alpha).max(initial=0) < 1e-4
        assert (np.abs(slope[best == 0]) <= alpha + 1e-4).all()
    v, _, _ = S.sparse_dictionary(c, 3, alpha=6.0, rounds=400, tolerance=0.0)
    assert {tuple(np.flatnonzero(r)) for r in v} == {(0, 1, 2), (3, 4), (5, 6, 7)}


def test_sparse_map_is_the_ridge(products):
    x, c = products
    v, _, _ = S.sparse_dictionary(c, 3, alpha=4.0)
    w = S.unit(v)
    want = np.linalg.solve(np.vstack([w.T, 0.1 * np.eye(3)]).T @ np.vstack([w.T, 0.1 * np.eye(3)]), w @ x.T).T
    assert np.allclose(x @ S.ridge_map(v, 0.01), want)




def test_extra_trees_a_batch_at_a_time(spark, rows, monkeypatch):
    """The driver never has more trees than max_nodes allows; importance and scores are means over all of them."""
    grown, plain = [], E.fit
    monkeypatch.setattr(E, "fit", lambda *a, **b: grown.append(plain(*a, **b)) or grown[-1])
    found, scored = E.explained(rows, [0, 1, 2], 5, rows.select("id", "fold", "vector"), trees=5, max_nodes=3 * 2 * 240 * 2)
    assert [f.trees for f in grown] == [2, 2, 1] and max(len(f.feature) for f in grown) <= 3 * 2 * 240 * 2
    assert len({f.cut[0] for f in grown}) == 3
    want = E._normal(sum(f.trees * E._shares(f, 5) for f in grown)).mean(axis=0)
    assert np.allclose([r["mean"] for r in found.orderBy("feature").collect()], want)
    got = scored.orderBy("id").collect()
    assert len(got) == 240
    for r in got[::40]:
        assert r.score == pytest.approx(sum(f.trees * f.probability(np.array([r.vector]), r.fold)[0] for f in grown) / 5)


@pytest.mark.parametrize("width, bins", [(6, 32), (7, 64), (1, 8)])
def test_two_features_are_counted_together(width, bins):
    """Sums of weights by the bins of two features give those of each by itself, for the last of an odd number too."""
    draw = np.random.default_rng(width)
    codes, weights, slot = draw.integers(0, bins, (width, 500)), draw.integers(-9, 9, 500).astype(float), draw.integers(0, 3, 500)
    places = B._joint(codes.astype(np.uint8), bins)
    assert places.shape == (-(-width // 2), 500)
    sums = np.stack([np.bincount(p + slot * bins * bins, weights, 3 * bins * bins) for p in places]).reshape(len(places), 3, bins * bins)
    want = np.stack([np.bincount(c + slot * bins, weights, 3 * bins).reshape(3, bins) for c in codes])
    assert (B._apart(sums[None, None], bins)[0, 0, :width] == want).all()


@pytest.mark.parametrize("bins", [16, 100])
def test_histograms_of_an_odd_number_of_features(rows, points, bins):
    x, y, fold = points
    o = B.Options(rounds=1, depth=2, rows=1.0, columns=1.0, bins=bins)
    trees = B.fit(rows, [0, -1], o)
    table, parts = B.binned(rows, trees.cuts, 2)
    codes, slots = B._codes(x, trees.cuts), np.array([[-1, 0, 1]] * 2)
    sums = B.histograms(table, trees, 0, 0, slots, [0, -1], o, parts)
    assert sums.shape == (2, 2, x.shape[1], bins, 2)
    for m, held in enumerate((0, -1)):
        p = 1 / (1 + np.exp(-trees.base[m]))
        for s in range(2):
            node = trees._reached(codes.T, m, 0, np.arange(3))[: len(x)] - 1 if trees.feature[m, 0, 0] >= 0 else np.full(len(x), -9)
            own = (fold != held) & (node == s)
            for j in range(x.shape[1]):
                assert np.allclose(sums[m, s, j, :, 0], np.bincount(codes[own, j], (p - y[own]), bins), atol=1e-4)


def test_extra_trees_are_the_same_within_tasks_and_across_them(rows, monkeypatch):
    """Nodes of few rows grow to their leaves in a job, not two jobs a level, and how few these are changes no tree."""
    passes, plain = [], E._grouped
    monkeypatch.setattr(E, "_grouped", lambda *a: passes.append(1) or plain(*a))
    inside = E.fit(rows, [0, 2], trees=7)
    assert not passes
    for least in (60, 1):
        across = E.fit(rows, [0, 2], trees=7, rows_a_task=least, max_frontier=10_000)
        assert passes and all((getattr(inside, k) == getattr(across, k)).all() for k in ("feature", "cut", "left", "n", "ones"))
    shallow = [E.fit(rows, [1], trees=4, depth=3, rows_a_task=r) for r in (10_000, 50)]
    assert (shallow[0].feature == shallow[1].feature).all() and 4 * 3 < (shallow[0].n > 0).sum() <= 4 * 15


def test_rows_that_follow_another_reach_the_leaves_of_their_own_values(forest, points):
    """Permuted rows go their base row's way only as far as their own values lead there, whatever order rows come in."""
    x, rng = points[0], np.random.default_rng(8)
    near = np.repeat(x[:40], 6, axis=0)
    for i in range(len(near)):
        if i % 6:
            near[i, i % 6 - 1] = x[rng.integers(240), i % 6 - 1]
    twice = np.concatenate([near[:12], near[:12][::-1], near[1:2], near[1:2], x[100:103]])
    for some in (near, near[rng.permutation(len(near))], twice, x, x[:1]):
        assert (forest._leaves(some, slice(0, 60)) == forest.places(some, slice(0, 60))).all()
    first, differs = E._followed(near)
    assert (first == np.arange(len(near)) // 6 * 6).all() and set(differs[::6]) == {-1}
