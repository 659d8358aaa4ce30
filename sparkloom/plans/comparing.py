"""Queries: partitions, clusters, candidates and correlated features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.expressions import minmax
from sparkloom.operators import partitions as P
from sparkloom.operators import selection as C
from sparkloom.operators.cluster import consensus
from sparkloom.operators.describe import median_deviation
from sparkloom.plans.registry import LONG, embedding_long, embedding_points, query, rounded, table

_CELLS = "cells AS (SELECT label % 2 AS a, label % 6 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("p"), (F.col("label") % 6).alias("q"))
    return P.contingency(e, "p", "q")


@query(f"WITH {_CELLS} SELECT a, b, n FROM cells")
def partition_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


_AGREE = """r AS (SELECT a, sum(n) AS n FROM cells GROUP BY a), c AS (SELECT b, sum(n) AS n FROM cells GROUP BY b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cells),
x AS (SELECT t, (SELECT sum(n * (n - 1) / 2.0) FROM cells) AS ab, (SELECT sum(n * (n - 1) / 2.0) FROM r) AS pa, (SELECT sum(n * (n - 1) / 2.0) FROM c) AS pb,
  (SELECT -sum(n / t * ln(n / t)) FROM cells) AS hab, (SELECT -sum(n / t * ln(n / t)) FROM r) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM c) AS hb FROM t),
k AS (SELECT *, pa * pb / (t * (t - 1) / 2) AS e FROM x)"""


@query(f"WITH {_CELLS}, {_AGREE} SELECT CAST(t AS BIGINT) AS n, round((ab - e) / ((pa + pb) / 2 - e), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi FROM k")
def partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.agreement(_cells(spark, sf_dir)))


@query(f"WITH {_CELLS} SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS row_share, round(n / sum(n) OVER (PARTITION BY b), 6) AS column_share FROM cells")
def crosswalk_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.crosswalk(_cells(spark, sf_dir)))


@query("""WITH cells AS (SELECT event_type AS a, user_id AS b, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a, b, n FROM cells QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1""")
def majority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.majority(P.contingency(table(spark, sf_dir, "events"), "event_type", "user_id"))


@query("""WITH g AS (SELECT i AS label, (SELECT count(*) FROM embeddings e WHERE e.label = i) AS n FROM range(12) t(i))
SELECT CAST(sum(n) AS BIGINT) AS n, string_agg(label || ':' || n, ';' ORDER BY label) AS sizes, min(n) AS min_size, max(n) AS max_size, round(min(n) / sum(n), 6) AS min_ratio, round(max(n) / sum(n), 6) AS max_ratio,
  CASE WHEN min(n) > 0 THEN max(n) / min(n) ELSE CAST('inf' AS DOUBLE) END AS imbalance FROM g""")
def cluster_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.cluster_sizes(table(spark, sf_dir, "embeddings"), "label", 12))


@query("SELECT label, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM embeddings GROUP BY label")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.group_shares(table(spark, sf_dir, "embeddings"), "label"))


_PROFILE = f"""{LONG}, o AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY feature),
p AS (SELECT feature, label, avg(x) AS mean, (avg(x) - any_value(m)) / any_value(s) AS z_mean FROM long JOIN o USING (feature) GROUP BY feature, label),
q AS (SELECT *, (sum(z_mean) OVER w - z_mean) / (count(*) OVER w - 1) AS z_other, max(z_mean) OVER w - min(z_mean) OVER w AS z_spread FROM p WINDOW w AS (PARTITION BY feature))"""


@query(f"WITH {_PROFILE} SELECT feature, label, round(mean, 6) AS mean, round(z_mean, 6) AS z_mean, round(z_other, 6) AS z_other, round(z_spread, 6) AS z_spread FROM q")
def profile_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.profiles(embedding_long(spark, sf_dir), "label"))


@query(f"""WITH {_PROFILE} SELECT label, feature, round(z_mean - z_other, 6) AS contrast, CASE WHEN z_mean > z_other THEN 'higher' ELSE 'lower' END AS direction,
  row_number() OVER (PARTITION BY label ORDER BY round(abs(z_mean - z_other), 9) DESC, feature) AS place FROM q QUALIFY place <= 10""")
def one_vs_rest_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.contrasts(embedding_long(spark, sf_dir), "label").select("label", "feature", "contrast", "direction", "place"))


#: Candidates with metrics that both engines derive alike from customers by nation and segment.
_CAND = """cand AS (SELECT c_nationkey * 10 + ascii(substr(c_mktsegment, 1, 1)) % 10 AS id, (['top20', 'top50', 'all'])[1 + c_nationkey % 3] AS feature_set,
  avg(c_acctbal) / 10000 AS silhouette, stddev_pop(c_acctbal) AS calinski_harabasz, max(c_acctbal) / 1000 AS davies_bouldin, CAST(count(*) AS DOUBLE) / 20 AS stability,
  CAST(count(*) % 7 AS DOUBLE) / 7 AS balance, CAST(c_nationkey % 5 AS DOUBLE) / 5 AS nmi, count(*) AS size FROM customer GROUP BY c_nationkey, c_mktsegment)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, x = F.count("*"), F.col("c_acctbal")
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        (F.avg(x) / 10000).alias("silhouette"), F.stddev_pop(x).alias("calinski_harabasz"), (F.max(x) / 1000).alias("davies_bouldin"), (n.cast("double") / 20).alias("stability"), ((n % 7).cast("double") / 7).alias("balance"), n.alias("size")
    )
    sets = F.lit(["top20", "top50", "all"])
    return own.select(
        (F.col("c_nationkey") * 10 + F.ascii(F.substring("c_mktsegment", 1, 1)) % 10).alias("id"),
        F.get(sets, F.col("c_nationkey") % 3).alias("feature_set"),
        "silhouette", "calinski_harabasz", "davies_bouldin", "stability", "balance", ((F.col("c_nationkey") % 5).cast("double") / 5).alias("nmi"), "size",
    )


def _scaled(m: str) -> str:
    value = f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())"
    return value if C.SCALED.get(m, True) else f"1 - {value}"


def _composite(weights: dict[str, float], bonus: dict[str, float]) -> str:
    parts = " + ".join(f"{w} * ({_scaled(m) if m in C.SCALED else m})" for m, w in weights.items())
    extra = "CASE feature_set " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bonus.items()) + " END"
    return f"{_CAND}, s AS (SELECT *, size >= 8 AS eligible, CASE WHEN size >= 8 THEN {parts} + {extra} ELSE CAST('-inf' AS DOUBLE) END AS score FROM cand)"


def _first(condition: str) -> str:
    return f"(SELECT id FROM s WHERE eligible AND {condition} ORDER BY score DESC, id LIMIT 1)"


@query(f"WITH {_CAND} SELECT id, round({_scaled('silhouette')}, 6) AS silhouette, round({_scaled('davies_bouldin')}, 6) AS davies_bouldin FROM cand")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return rounded(c.select("id", minmax(F.col("silhouette")).alias("silhouette"), minmax(F.col("davies_bouldin"), higher_is_better=False).alias("davies_bouldin")))


@query(f"""WITH {_composite(C.WEIGHTS_2, C.BONUS_2)}, b AS (SELECT max(score) AS m, {_first('true')} AS id FROM s), k AS (SELECT coalesce({_first("feature_set = 'top20' AND score >= (SELECT m FROM b) - 0.03")},
  CASE WHEN (SELECT feature_set FROM s WHERE s.id = (SELECT id FROM b)) = 'all' THEN {_first("feature_set IN ('top20', 'top50') AND score >= (SELECT m FROM b) - 0.08")} END, (SELECT id FROM b)) AS id)
SELECT s.id, feature_set, eligible, round(score, 6) AS score, coalesce(s.id = (SELECT id FROM k), false) AS recommended FROM s""")
def composite_selection_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = C.composite_scores(_candidates(spark, sf_dir), C.WEIGHTS_2, C.BONUS_2, F.col("size") >= 8)
    return rounded(C.choose_2(scored).select("id", "feature_set", "eligible", "score", "recommended"))


@query(f"""WITH {_composite(C.WEIGHTS_6, C.BONUS_6)}, b AS (SELECT {_first('true')} AS id), b1 AS (SELECT coalesce(CASE WHEN (SELECT feature_set FROM s WHERE s.id = (SELECT id FROM b)) = 'all'
  THEN {_first("feature_set IN ('top20', 'top50') AND score >= (SELECT max(score) FROM s) - 0.08")} END, (SELECT id FROM b)) AS id),
b2 AS (SELECT coalesce(CASE WHEN (SELECT feature_set FROM s WHERE s.id = (SELECT id FROM b1)) = 'top20'
  THEN {_first("feature_set = 'top50' AND score >= (SELECT s2.score FROM s s2 WHERE s2.id = (SELECT id FROM b1)) - 0.03")} END, (SELECT id FROM b1)) AS id)
SELECT s.id, feature_set, eligible, round(score, 6) AS score, coalesce(s.id = (SELECT id FROM b2), false) AS recommended FROM s""")
def composite_selection_k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = C.composite_scores(_candidates(spark, sf_dir), C.WEIGHTS_6, C.BONUS_6, F.col("size") >= 8)
    return rounded(C.choose_6(scored).select("id", "feature_set", "eligible", "score", "recommended"))


_METRICS = ["silhouette", "stability", "balance", "nmi"]
_PRIMES = {"silhouette": 7, "stability": 11, "balance": 13, "nmi": 17}


@query(f"""WITH {_CAND}, w AS (SELECT i AS run, {", ".join(f"i % {p} / {p}.0 AS w_{m}" for m, p in _PRIMES.items())} FROM range(500) t(i)),
r AS (SELECT id, row_number() OVER (PARTITION BY run ORDER BY round({" + ".join(f"w_{m} * {m}" for m in _METRICS)}, 9) DESC, id) AS place FROM w CROSS JOIN cand)
SELECT id, count(*) FILTER (place = 1) AS top1, count(*) FILTER (place <= 3) AS top3, round(count(*) FILTER (place = 1) / 500.0, 6) AS top1_share, round(count(*) FILTER (place <= 3) / 500.0, 6) AS top3_share FROM r GROUP BY id""")
def weight_sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(500).select(F.col("id").alias("run"), *[((F.col("id") % p) / F.lit(float(p))).alias(m) for m, p in _PRIMES.items()])
    return rounded(C.weight_sensitivity(_candidates(spark, sf_dir), grid, _METRICS))


@query()
def weight_sensitivity_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = C.dirichlet_weights(spark, _METRICS, 10_000)
    return C.weight_sensitivity(_candidates(spark, sf_dir), weights, _METRICS)


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]
_PAIRS = [(a, b) for k, a in enumerate(_NUMERIC) for b in _NUMERIC[k + 1 :]]
_CORR = "pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, abs(corr({a}, {b})) AS r FROM lineitem" for a, b in _PAIRS) + ")"
_LIMIT = 0.01
_COMPONENTS = f"""links AS (SELECT i AS a, j AS b FROM pairs WHERE r > {_LIMIT} UNION ALL SELECT j, i FROM pairs WHERE r > {_LIMIT}),
f AS (SELECT unnest({_NUMERIC}) AS feature), walk AS (SELECT feature, feature AS reached FROM f UNION SELECT feature, b FROM walk JOIN links ON reached = a),
comp AS (SELECT feature, min(reached) AS component FROM walk GROUP BY feature)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _NUMERIC])


@query(f"WITH {_CORR} SELECT i, j, round(r, 6) AS r FROM pairs")
def corr_matrix_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.correlations(_lines(spark, sf_dir), _NUMERIC))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(c,) for c in _NUMERIC], "feature string")
    return C.feature_components(names, C.correlations(_lines(spark, sf_dir), _NUMERIC), _LIMIT)


@query(f"WITH RECURSIVE {_CORR}, {_COMPONENTS} SELECT feature, component FROM comp")
def corr_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


_SPREAD = "d AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, mad({c}) AS mad FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM lineitem)" for c in _NUMERIC) + ")"


@query(f"WITH RECURSIVE {_CORR}, {_COMPONENTS}, {_SPREAD} SELECT component, feature, count(*) OVER (PARTITION BY component) AS size FROM comp JOIN d USING (feature) QUALIFY row_number() OVER (PARTITION BY component ORDER BY iqr DESC, mad DESC, feature DESC) = 1")
def corr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _lines(spark, sf_dir).unpivot([], _NUMERIC, "feature", "x")
    return C.representatives(_components(spark, sf_dir), median_deviation(long, ["feature"]))


_RUNS = "runs AS (SELECT vec_id AS id, r AS run, vec_id % (r + 2) AS label, label AS whole FROM embeddings, range(5) t(r) WHERE vec_id % 5 <> r)"


@query(f"""WITH {_RUNS}, p AS (SELECT a.whole = b.whole AS same, a.label = b.label AS together FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id)
SELECT round(avg(CAST(together AS INT)) FILTER (same), 6) AS within, round(avg(CAST(together AS INT)) FILTER (NOT same), 6) AS between,
  round(avg(CAST(together AS INT)) FILTER (same) - avg(CAST(together AS INT)) FILTER (NOT same), 6) AS separation FROM p""")
def consensus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_points(spark, sf_dir).select("id", F.col("label").alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run")).where("id % 5 <> run")
    return rounded(consensus(rows.withColumn("label", F.col("id") % (F.col("run") + 2))))
