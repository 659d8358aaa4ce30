"""Queries: folds, classifier metrics, internal quality and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import audit as A
from sparkloom.operators import metrics as M
from sparkloom.operators.ranking import cumulative_counts
from sparkloom.plans.registry import LONG, RECORDS, embedding_long, embedding_points, query, records, rounded, table

#: A label and a score that both engines compute alike; events are the records of a user.
_SCORED = """scored AS (SELECT event_id AS id, user_id, CAST(user_id % 5 AS INT) AS fold, CAST(user_id % 3 = 0 AS INT) AS y,
  (event_id * 7919 % 1000 + 250 * CAST(user_id % 3 = 0 AS INT)) / 1250.0 AS score FROM events)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (F.col("user_id") % 3 == 0).cast("int")
    score = ((F.col("event_id") * 7919 % 1000 + 250 * y) / F.lit(1250.0)).alias("score")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 5).cast("int").alias("fold"), y.alias("y"), score)


_CONF = """count(*) AS n, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp"""
_MET = """SELECT *, coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c"""
_NAMES = ["accuracy", "sensitivity", "specificity", "precision", "f1", "balanced_accuracy"]


@query(f"WITH {_SCORED} SELECT fold, {_CONF} FROM scored GROUP BY fold")
def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_scored(spark, sf_dir), ["fold"], "y", "score")


@query(f"WITH {_SCORED}, c AS (SELECT fold, {_CONF} FROM scored GROUP BY fold) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM c")
def confusion_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_scored(spark, sf_dir), ["fold"], "y", "score").agg(*[F.sum(c).alias(c) for c in ("n", "tn", "fp", "fn", "tp")])


_BINARY = f"{_SCORED}, c AS (SELECT fold, {_CONF} FROM scored GROUP BY fold), m AS (SELECT *, coalesce((sensitivity + specificity) / 2, sensitivity, specificity) AS balanced_accuracy FROM ({_MET}))"


@query(f"WITH {_BINARY} SELECT fold, n, tn, fp, fn, tp, " + ", ".join(f"round({m}, 6) AS {m}" for m in _NAMES) + " FROM m")
def metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.binary_metrics(M.confusion(_scored(spark, sf_dir), ["fold"], "y", "score")))


_AUC = """ranked AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM scored),
a AS (SELECT fold, CAST(sum(y) AS DOUBLE) AS p, count(*) - CAST(sum(y) AS DOUBLE) AS q, sum(rk) FILTER (y = 1) AS r FROM ranked GROUP BY fold)"""


@query(f"WITH {_SCORED}, {_AUC} SELECT fold, round((r - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.auc(_scored(spark, sf_dir), ["fold"], "y", "score"))


@query(f"WITH {_SCORED} SELECT user_id, min(y) AS y, round(avg(score), 6) AS score, count(*) AS records FROM scored GROUP BY user_id")
def subject_prob_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.subject_scores(_scored(spark, sf_dir), "user_id", "y", "score"))


@query(f"WITH {_BINARY}, l AS (UNPIVOT (SELECT fold, {', '.join(_NAMES)} FROM m) ON {', '.join(_NAMES)} INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY metric")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fold_summary(M.binary_metrics(M.confusion(_scored(spark, sf_dir), ["fold"], "y", "score")), [], _NAMES))


#: A prediction for ten classes that is right for most rows.
_CALLED = "called AS (SELECT vec_id AS id, label, CAST(CASE WHEN vec_id % 4 = 0 THEN (label + vec_id) % 10 ELSE label END AS INT) AS predicted FROM embeddings)"


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.when(F.col("vec_id") % 4 == 0, (F.col("label") + F.col("vec_id")) % 10).otherwise(F.col("label")).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", off.alias("predicted"))


@query(f"WITH {_CALLED} SELECT CAST(t AS INT) AS \"true\", CAST(p AS INT) AS predicted, (SELECT count(*) FROM called c WHERE c.label = t AND c.predicted = p) AS n FROM range(10) a(t), range(10) b(p)")
def confusion_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_long(_called(spark, sf_dir), "label", "predicted", list(range(10)))


@query(f"""WITH {_CALLED}, k AS (SELECT c, (SELECT count(*) FROM called WHERE label = c) AS s, (SELECT count(*) FROM called WHERE predicted = c) AS d, (SELECT count(*) FROM called WHERE label = c AND predicted = c) AS h FROM range(10) t(c)),
m AS (SELECT *, coalesce(h / nullif(s, 0), 0) AS r, coalesce(h / nullif(d, 0), 0) AS p, coalesce(2 * h / nullif(s + d, 0), 0) AS f FROM k WHERE s + d > 0)
SELECT round(sum(h) / sum(s), 6) AS accuracy, round(avg(r) FILTER (s > 0), 6) AS balanced_accuracy, round(avg(f), 6) AS f1_macro, round(sum(f * s) / sum(s), 6) AS f1_weighted, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro FROM m""")
def metrics_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.multiclass_metrics(M.confusion_long(_called(spark, sf_dir), "label", "predicted", list(range(10)))))


@query("""WITH r AS (SELECT c, label = c AS y, -abs(CAST(embedding[1] AS DOUBLE) - c / 10.0) AS s FROM embeddings, range(10) t(c)),
k AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS rk FROM r),
a AS (SELECT c, CAST(count(*) FILTER (y) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS q, sum(rk) FILTER (y) AS r FROM k GROUP BY c)
SELECT round(avg((r - p * (p + 1) / 2) / (p * q)), 6) AS auc_macro FROM a""")
def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = -F.abs(F.get("vector", F.lit(0)) - F.col("class") / 10.0)
    rows = M.one_vs_rest(embedding_points(spark, sf_dir), "label", list(range(10)), score)
    per = M.auc(rows, ["class"], "y", "score")
    return rounded(per.agg(F.when(F.count("auc") == 10, F.avg("auc")).alias("auc_macro")))


_FOLDS = f"""{RECORDS}, s AS (SELECT id, min(y) AS y FROM records GROUP BY id), f AS (SELECT id, CAST((row_number() OVER (PARTITION BY y ORDER BY id) - 1) % 5 AS INT) AS fold FROM s)"""


def _subjects_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the fold of their subject; dealt in the order of ids, so that SQL can follow."""
    own = records(spark, sf_dir)
    subjects = own.groupBy("id").agg(F.min("y").alias("y"))
    return own.join(cumulative_counts(subjects, ["y"], "id").select("id", (F.col("before") % 5).cast("int").alias("fold")), "id")


@query(f"WITH {_FOLDS} SELECT id, fold FROM f")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects_dealt(spark, sf_dir).select("id", "fold").distinct()


@query(f"""WITH {_FOLDS}, p AS (SELECT s.id, s.y, f.fold AS own, (SELECT count(*) FROM records r WHERE r.id = s.id) AS records FROM s JOIN f USING (id))
SELECT CAST(k AS INT) AS fold, count(*) FILTER (own <> k) AS train_subjects, count(*) FILTER (own = k) AS test_subjects, CAST(sum(CASE WHEN own <> k THEN records ELSE 0 END) AS BIGINT) AS train_records,
  CAST(sum(CASE WHEN own = k THEN records ELSE 0 END) AS BIGINT) AS test_records, count(*) FILTER (own = k AND y = 1) AS test_positive, CAST(0 AS BIGINT) AS overlap FROM p, range(5) t(k) GROUP BY k""")
def fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold_audit(_subjects_dealt(spark, sf_dir), "id", "y")


@query()
def stratified_hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = records(spark, sf_dir).groupBy("id").agg(F.min("y").alias("y"))
    return M.stratified_folds(subjects, "id", "y")


@query()
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of orders with unlike numbers of lines, balanced by lines of each class: (fold, y, records, subjects)."""
    lines = records(spark, sf_dir).select("id", "y")
    return lines.join(M.group_folds(lines, "id", "y"), "id").groupBy("fold", "y").agg(F.count("*").alias("records"), F.countDistinct("id").alias("subjects"))


@query(f"WITH {_FOLDS} SELECT count(*) AS leaked FROM (SELECT id FROM records JOIN f USING (id) GROUP BY id HAVING count(DISTINCT fold) > 1)")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _subjects_dealt(spark, sf_dir).groupBy("id").agg((F.min("fold") != F.max("fold")).alias("leaks"))
    return per.agg(F.count_if("leaks").alias("leaked"))


@query(f"""WITH {LONG}, c AS (SELECT label, feature, avg(x) AS c, count(*) AS n FROM long GROUP BY ALL), o AS (SELECT feature, avg(x) AS m FROM long GROUP BY feature),
w AS (SELECT sum((x - c) ^ 2) AS w FROM long JOIN c USING (label, feature)), b AS (SELECT sum(n * (c - m) ^ 2) AS b, count(DISTINCT label) AS k FROM c JOIN o USING (feature)),
d AS (SELECT label, avg(d) AS s FROM (SELECT id, label, sqrt(sum((x - c) ^ 2)) AS d FROM long JOIN c USING (label, feature) GROUP BY ALL) GROUP BY label),
g AS (SELECT x.label AS i, y.label AS j, sqrt(sum((x.c - y.c) ^ 2)) AS gap FROM c x JOIN c y ON x.feature = y.feature AND x.label <> y.label GROUP BY ALL),
r AS (SELECT i, max((a.s + e.s) / gap) AS r FROM g JOIN d a ON a.label = i JOIN d e ON e.label = j GROUP BY i)
SELECT round((SELECT b / (k - 1) FROM b) / ((SELECT w FROM w) / ((SELECT count(*) FROM embeddings) - (SELECT k FROM b))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin""")
def centroid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.centroid_quality(embedding_long(spark, sf_dir), "id", "label"))


@query("""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id, a.label, b.label AS c, sum(list_distance(a.v, b.v)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT id, label, max(n) FILTER (label = c) AS n, max(d / nullif(n - 1, 0)) FILTER (label = c) AS a, min(d / n) FILTER (label <> c) AS b FROM d GROUP BY id, label)
SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY label""")
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.silhouette(embedding_points(spark, sf_dir), "id", "label", "vector")
    return rounded(per.groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette")))


_CHECKS = [
    ("lines", "rows", "count(*)", "value > 0", "> 0", "fail"),
    ("lines", "null keys", "count(*) FILTER (WHERE l_orderkey IS NULL)", "value = 0", "0", "fail"),
    ("lines", "negative quantity", "count(*) FILTER (WHERE l_quantity < 0)", "value = 0", "0", "fail"),
    ("lines", "discount over 0.09", "count(*) FILTER (WHERE l_discount > 0.09)", "value = 0", "0", "warning"),
]


@query(" UNION ALL ".join(f"SELECT '{s}' AS stage, '{n}' AS check_name, '{e}' AS expected, CAST(value AS DOUBLE) AS observed, CASE WHEN {ok} THEN 'pass' ELSE '{sev}' END AS status, '{sev}' AS severity FROM (SELECT {v} AS value FROM lineitem)" for s, n, v, ok, e, sev in _CHECKS))
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [A.Check(s, n, F.expr(v), F.expr(ok), e, sev) for s, n, v, ok, e, sev in _CHECKS]
    return A.run_checks(table(spark, sf_dir, "lineitem"), checks)


@query("""WITH c AS (SELECT count(*) FILTER (WHERE l_discount > 0.09) > 0 AS w FROM lineitem) SELECT CAST(4 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_fail, CAST(w AS BIGINT) AS n_warning, CASE WHEN w THEN 'CONDITIONAL PASS' ELSE 'PASS' END AS verdict FROM c""")
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.verdict(audit_checks(spark, sf_dir))


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in ("region", "nation", "customer", "orders", "lineitem")))
def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "orders", "lineitem")
    rows = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).withColumn("t", F.lit(t)) for t in names]
    return reduce(DataFrame.unionByName, rows).agg(*[F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in names])


_REPORTS = {"contact": "(?i)@|phone", "secrets": "(?i)token|password|secret", "licence": "(?i)licen[cs]e"}


@query("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in _REPORTS.items()) + " FROM documents")
def regex_report_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(*[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in _REPORTS.items()])


_WORDS = {"token": "fail", "license": "warning", "the": "safe"}


@query("WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS INT) AS line_no, '{k}' AS keyword, '{s}' AS status FROM l WHERE contains(lower(line), '{k}')" for k, s in _WORDS.items()))
def static_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan_lines(table(spark, sf_dir, "documents"), "doc_id", "text", _WORDS)


@query("""WITH a AS (SELECT label % 6 AS g, count(*) AS n FROM embeddings GROUP BY 1), b AS (SELECT label % 7 AS g, count(*) AS n FROM embeddings GROUP BY 1)
SELECT g, coalesce(a.n, 0) AS "left", coalesce(b.n, 0) AS "right" FROM a FULL JOIN b USING (g) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def crosswalk_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = lambda k: table(spark, sf_dir, "embeddings").groupBy((F.col("label") % k).alias("g")).agg(F.count("*").alias("n"))
    return A.mismatches(sizes(6), sizes(7), ["g"], "n")


@query(f"WITH {_SCORED} SELECT fold, user_id, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, user_id) AS place FROM scored GROUP BY fold, user_id QUALIFY place <= 3")
def top_subjects_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _scored(spark, sf_dir).groupBy("fold", "user_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("n"), "user_id"))
    return n.withColumn("place", place).where("place <= 3")
