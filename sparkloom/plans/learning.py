"""Queries: models under cross-validation, importance, clusterings and their stability."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import boosting as B
from sparkloom.operators import cluster as C
from sparkloom.operators import evidence as V
from sparkloom.operators import extra_trees as E
from sparkloom.operators import metrics as M
from sparkloom.operators import fits as X
from sparkloom.operators import linear as N
from sparkloom.operators import models as L
from sparkloom.operators import selection as S
from sparkloom.operators import sparse_pca as SP
from sparkloom.operators import stats as T
from sparkloom.operators.describe import feature_audit
from sparkloom.operators.reports import assignment_table
from sparkloom.plans.registry import embedding_long, embedding_points, query
from sparkloom.sources.shared import stored

WIDTH = 64
FOLDS = [0, 1, 2, 3, 4]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, vector, fold): label < 5 as the class, in stratified folds."""
    points = embedding_points(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))
    folds = M.stratified_folds(points.select("id", "y"), "id", "y").select("id", "fold")
    return L.dealt(points.join(folds, "id").select("id", "y", "vector", "fold"), points.count()).persist()


def _cv(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return L.evaluate(L.cross_validate(_rows(spark, sf_dir), make))


@query()
def logreg_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five folds' models are fitted together."""
    rows = _rows(spark, sf_dir)
    return L.evaluate(N.scores(rows, N.fit(*N.prepared(rows, FOLDS), [N.Model(f) for f in FOLDS], FOLDS)))


@query()
def rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_cv(spark, sf_dir, 500)


def forest_cv(spark: SparkSession, sf_dir: str, trees: int) -> DataFrame:
    return _cv(spark, sf_dir, lambda n: L.forest(n, trees=trees))


@query()
def gbt_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees at their declared size, 120 rounds of depth 2, the five folds grown together."""
    rows = _rows(spark, sf_dir)
    return L.evaluate(B.scores(rows, B.fit(rows, FOLDS), FOLDS))


@query()
def svm_rbf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are the logistic function of decision values; calibrate=True would fit 25 more machines for probabilities."""
    return _cv(spark, sf_dir, lambda n: L.radial_svm(n, iterations=15))


@query()
def l1_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often L1 models keep a feature, each with the penalty that its inner folds favour: 75 fits for the search and 5 more."""
    return N.l1_stability(_rows(spark, sf_dir), FOLDS, L.L1_CS)


@query()
def tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tree_importance(_rows(spark, sf_dir))


@query()
def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain importance and Shapley values of boosted trees over the folds, with their ranks."""
    return B.importance(_rows(spark, sf_dir), FOLDS)


@query()
def shap_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to a held-out row's margin above the model's base, by the model that holds the row's fold."""
    rows = _rows(spark, sf_dir)
    found = B.shap_rows(rows, B.fit(rows, FOLDS), FOLDS)
    return found.select("id", "fold", "base", "margin", F.posexplode("contributions").alias("feature", "contribution"))


@query()
def extra_trees_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of 500 extremely randomised trees a fold, and how far their balanced accuracy on the held-out fold falls when a feature is permuted."""
    rows = _rows(spark, sf_dir)
    importance, scored = E.explained(rows, FOLDS, WIDTH, L.permuted_rows(rows, WIDTH))
    fall = L.accuracy_fall(stored(scored.select("y", "fold", "feature", "score"), "permuted-scores"))
    fall = fall.select("feature", F.col("mean").alias("permutation_mean"), F.col("std").alias("permutation_std"))
    return importance.join(fall, "feature")


@query()
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests, L1 stability, extra-trees and permutation importance of every feature, ranked and flagged; boosting's is optional and left out here."""
    rows, long = _rows(spark, sf_dir), embedding_long(spark, sf_dir)
    importance, scored = E.explained(rows, FOLDS, WIDTH, L.permuted_rows(rows, WIDTH))
    fall = L.accuracy_fall(stored(scored.select("y", "fold", "feature", "score"), "permuted-scores"))
    tests = T.univariate_screen(long, F.col("label") < 5).select("feature", "category", "p_mannwhitney", "q_mannwhitney", "cohens_d", "abs_cohens_d", "cliffs_delta", "abs_cliffs_delta")
    return V.evidence_summary(tests, feature_audit(long), N.l1_stability(rows, FOLDS, L.L1_CS), importance, fall)


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.permutation_importance(_rows(spark, sf_dir), L.logistic, WIDTH)


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.standardised(embedding_points(spark, sf_dir)).select("id", "label", "features").withColumnRenamed("label", "known").persist()


@query()
def pca_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coordinates(_data(spark, sf_dir))


@query()
def pca_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components for 90 % of the variance."""
    return spark.createDataFrame([(C.components_for(_data(spark, sf_dir), WIDTH),)], "components int")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_points(spark, sf_dir).select("id", array_to_vector("vector").alias("features"))


def _clustered(spark: SparkSession, sf_dir: str, method: str, k: int = 6) -> DataFrame:
    sp = X.space(_vectors(spark, sf_dir), [X.Spec(k, 5)], runs=0)
    return X.labels_of(sp, {"kmeans": X.fit_kmeans, "mixture": X.fit_mixture, "ward": X.fit_ward}[method](sp)).select("id", "label")


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six clusters of five components, the best of 50 starts."""
    return _clustered(spark, sf_dir, "kmeans")


@query()
def gmm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "mixture")


@query()
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir, "ward")


@query()
def stability_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of 50 fits to four fifths of the points, scaled and projected anew, with the fit to all."""
    sp = X.space(_vectors(spark, sf_dir), [X.Spec(2, 5)], runs=50)
    ari = X.stability_of(sp, X.fit_kmeans(sp))[0]
    return spark.createDataFrame([(i, float(a)) for i, a in enumerate(ari)], "run int, ari double")


def _top20(representations: dict[str, int | None], ks: list[int]) -> dict[tuple[str, str], X.Spec]:
    return {("top20", f"{name}" if len(ks) == 1 else f"{name} k={k}"): X.Spec(k, components, tuple(range(20))) for name, components in representations.items() for k in ks}


@query()
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of twenty features in three representations by three methods, each with 50 resamples: quality, stability,
    eligibility and the composite score with the recommended candidate."""
    found, _ = X.candidate_stage(_vectors(spark, sf_dir), _top20({"scaled_only": None, "pca_5": 5, "pca_10": 10}, [2]))
    scored = S.composite_scores(found.withColumn("balance", S.balance_2(F.col("min_ratio"))), S.WEIGHTS_2, S.BONUS_2, S.eligible_2(F.col("min_ratio")))
    return S.choose_2(scored)


@query()
def k_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to eight clusters by three methods, with quality and the stability over 50 resamples."""
    return X.candidate_stage(_vectors(spark, sf_dir), _top20({"pca_5": 5}, list(range(2, 9))))[0]


@query()
def recommended_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From points to the table of assignments: candidates by Ward's method, the composite choice, and each point's cluster with its size and
    two coordinates."""
    found, fits = X.candidate_stage(_vectors(spark, sf_dir), _top20({"scaled_only": None, "pca_5": 5, "pca_10": 10}, [2]), methods={"ward": X.fit_ward})
    scored = S.composite_scores(found.withColumn("balance", S.balance_2(F.col("min_ratio"))), S.WEIGHTS_2, S.BONUS_2, S.eligible_2(F.col("min_ratio")))
    best = S.choose_2(scored).where("recommended").first()
    if best is None:
        raise ValueError("no candidate is eligible")
    labels = X.labels_of(*fits[best["id"]]).select("id", "label")
    return assignment_table(labels, embedding_points(spark, sf_dir).select("id", F.col("label").alias("known")), "id", C.coordinates(_data(spark, sf_dir)), f"{best['feature_set']} / {best['representation']} / {best['method']}")


def _labelled(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(id, y, vector, fold): the k-means cluster as the class, in stratified folds."""
    labels = _clustered(spark, sf_dir, "kmeans", k).withColumnRenamed("label", "y").persist()
    folds = M.stratified_folds(labels, "id", "y").select("id", "y", "fold")
    points = embedding_points(spark, sf_dir)
    return L.dealt(points.select("id", "vector").join(folds, "id"), points.count()).persist()


@query()
def cluster_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a logistic model finds the two k-means clusters again, by fold."""
    return L.evaluate(L.cross_validate(_labelled(spark, sf_dir, 2), L.logistic, at_once=len(FOLDS)))


@query()
def cluster_label_classifier_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a logistic model finds six k-means clusters again: metrics by fold, with the mean one-against-rest AUC."""
    called = L.cross_validate_classes(_labelled(spark, sf_dir, 6), L.logistic, at_once=len(FOLDS)).persist()
    cells = M.confusion_long(called, "y", "predicted", list(range(6)), ["fold"])
    return M.multiclass_metrics(cells, ["fold"]).join(L.auc_one_vs_rest(called, ["fold"], 6), "fold", "left")


@query()
def sparse_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loadings of 10 and of 20 sparse components."""
    data = _data(spark, sf_dir)
    ten, twenty = (SP.sparse_components(data, k).withColumn("n_components", F.lit(k)) for k in (10, 20))
    return ten.unionByName(twenty)
