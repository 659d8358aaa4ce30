"""Queries: ranks, tests, effect sizes and feature rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import direction, minus_log10
from sparkloom.operators import stats as S
from sparkloom.operators.describe import feature_audit, feature_zscores
from sparkloom.operators.ranking import adjust_fdr, average_rank_over, average_ranks, mean_rank, rank_evidence, top_n_each
from sparkloom.plans.registry import LONG, embedding_long, query, rounded

#: (label < 5) is the positive class of the embeddings.
_RANKED = f"""{LONG}, ranked AS (SELECT *, label < 5 AS y, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY feature, x) AS t FROM long)"""
_U = f"""{_RANKED}, s AS (SELECT feature, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, sum(rk) FILTER (y) AS r1, sum(t * t - 1.0) AS ties FROM ranked GROUP BY feature),
u AS (SELECT feature, n1, n0, r1 - n1 * (n1 + 1) / 2.0 AS u, CAST(n1 AS DOUBLE) * n0 AS nn, sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1.0)))) AS sd FROM s),
mw AS (SELECT feature, n1, n0, u, (greatest(u, nn - u) - nn / 2 - 0.5) / sd AS z, 2 * u / nn - 1 AS cliffs_delta FROM u)"""
_M = """m AS (SELECT feature, count(x) FILTER (label < 5) AS n1, count(x) FILTER (label >= 5) AS n0, avg(x) FILTER (label < 5) AS m1, avg(x) FILTER (label >= 5) AS m0,
  var_samp(x) FILTER (label < 5) AS v1, var_samp(x) FILTER (label >= 5) AS v0 FROM long GROUP BY feature)"""
_D = "(m1 - m0) / sqrt(((m.n1 - 1) * v1 + (m.n0 - 1) * v0) / (m.n1 + m.n0 - 2))"


def _positive() -> Column:
    return F.col("label") < 5


@query(f"WITH {LONG} SELECT id, feature, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM long WINDOW w AS (PARTITION BY feature)")
def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_zscores(embedding_long(spark, sf_dir)).select("id", "feature", "z"))


@query(f"WITH {_RANKED} SELECT id, feature, rk AS rank FROM ranked")
def avg_rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_ranks(embedding_long(spark, sf_dir), ["feature"], "x").select("id", "feature", "rank")


@query("""WITH r AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS rank FROM r) SELECT event_id, rank FROM k""")
def avg_rank_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return average_ranks(rows, ["event_type"], "v", descending=True).select("event_id", "rank")


@query(f"WITH {_U} SELECT feature, n1, n0, u, round(z, 6) AS z, round(cliffs_delta, 6) AS cliffs_delta FROM mw")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.mann_whitney(embedding_long(spark, sf_dir), _positive(), p_values=False))


@query(f"""WITH {LONG}, {_M} SELECT feature, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t,
  round((v1 / n1 + v0 / n0) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v0 / n0) ^ 2 / (n0 - 1)), 6) AS df FROM m""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.welch(embedding_long(spark, sf_dir), _positive(), p_values=False))


@query(f"""WITH {LONG}, r AS (SELECT feature, label % 6 AS g, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY feature, x) AS t FROM long), s AS (SELECT feature, g, count(*) AS n, sum(rk) AS r, sum(t * t - 1.0) AS ties FROM r GROUP BY feature, g),
a AS (SELECT feature, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q, sum(ties) AS ties FROM s GROUP BY feature)
SELECT feature, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h FROM a""")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.kruskal(embedding_long(spark, sf_dir).withColumn("g", F.col("label") % 6), "g", 6, p_values=False))


@query(f"WITH {_U}, {_M} SELECT feature, round({_D}, 6) AS cohens_d, round(cliffs_delta, 6) AS cliffs_delta, CASE WHEN {_D} > 0 THEN 'higher' WHEN {_D} < 0 THEN 'lower' ELSE 'equal' END AS direction FROM m JOIN mw USING (feature)")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = embedding_long(spark, sf_dir)
    both = S.cohens_d(long, _positive()).join(S.mann_whitney(long, _positive(), p_values=False), "feature")
    return rounded(both.select("feature", "cohens_d", "cliffs_delta", direction(F.col("cohens_d")).alias("direction")))


_BH = "p * count(p) OVER () / count(p) OVER (ORDER BY p NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_U}, p AS (SELECT feature, 1 / (1 + z * z) AS p FROM mw), r AS (SELECT *, {_BH} AS raw FROM p)
SELECT feature, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.mann_whitney(embedding_long(spark, sf_dir), _positive(), p_values=False).select("feature", (1 / (1 + F.col("z") * F.col("z"))).alias("p"))
    return rounded(adjust_fdr(p, "p", "q"))


@query()
def univariate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.univariate_screen(embedding_long(spark, sf_dir), _positive()), 9)


@query()
def separating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features that separate the classes best, by q-value."""
    screen = S.univariate_screen(embedding_long(spark, sf_dir), _positive())
    best = screen.orderBy(F.asc_nulls_last("q_mannwhitney"), F.asc_nulls_last("p_mannwhitney"), "feature").limit(10)
    return best.select("feature", "u", "z", "p_mannwhitney", "q_mannwhitney", "cliffs_delta", "cohens_d")


@query()
def volcano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a volcano chart."""
    screen = S.univariate_screen(embedding_long(spark, sf_dir), _positive())
    return screen.select("feature", "cohens_d", minus_log10(F.col("q_mannwhitney"), Window.partitionBy()).alias("minus_log10_q"))


_ONE = "rank() OVER (ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


@query(f"""WITH {_U}, {_M}, e AS (SELECT feature, round(abs(z), 9) AS a, round(abs({_D}), 9) AS b, round(abs(cliffs_delta), 9) AS c FROM m JOIN mw USING (feature)),
r AS (SELECT feature, {_ONE.format(v='a')} AS rank_a, {_ONE.format(v='b')} AS rank_b, {_ONE.format(v='c')} AS rank_c FROM e),
k AS (SELECT *, (rank_a + rank_b + rank_c) / 3 AS mean_rank FROM r)
SELECT feature, rank_a, rank_b, rank_c, round(mean_rank, 6) AS mean_rank, round(1 / mean_rank, 6) AS rank_score,
  row_number() OVER (ORDER BY round(mean_rank, 6), feature) AS place FROM k QUALIFY place <= 20""")
def mean_rank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = embedding_long(spark, sf_dir)
    d, u = S.cohens_d(long, _positive()), S.mann_whitney(long, _positive(), p_values=False)
    e = d.join(u, "feature", "left").select(F.lit(0).alias("all"), "feature", *[F.round(F.abs(v), 9).alias(n) for n, v in (("a", "z"), ("b", "cohens_d"), ("c", "cliffs_delta"))])
    e = e.select("*", *[average_rank_over(F.col(n), ["all"], descending=True).alias(f"rank_{n}") for n in "abc"])
    ranked = e.withColumn("mean_rank", F.round(mean_rank(["rank_a", "rank_b", "rank_c"]), 6)).withColumn("rank_score", 1 / mean_rank(["rank_a", "rank_b", "rank_c"]))
    top = top_n_each(ranked, ["all"], [F.asc("mean_rank"), F.asc("feature")], 20)
    return rounded(top.select("feature", "rank_a", "rank_b", "rank_c", "mean_rank", "rank_score", "place"))


_RANKS = f"""{_U}, {_M}, e AS (SELECT feature, round(abs(z), 9) AS u, round(abs({_D}), 9) AS d, round(abs(cliffs_delta), 9) AS delta FROM m JOIN mw USING (feature)),
a AS (SELECT feature, stddev_pop(x) <= 0.2 AS near_constant FROM long GROUP BY feature),
r AS (SELECT feature, {_ONE.format(v='u')} AS rank_u, {_ONE.format(v='d')} AS rank_d, {_ONE.format(v='delta')} AS rank_delta FROM e),
k AS (SELECT *, round((rank_u + rank_d + rank_delta) / 3, 6) AS mean_rank, row_number() OVER (ORDER BY round((rank_u + rank_d + rank_delta) / 3, 6), feature) AS place FROM r)"""


@query(f"WITH {_RANKS} SELECT feature, rank_u, rank_d, rank_delta, mean_rank, place, place <= 10 AS top10, place <= 20 AS top20, place <= 50 AS top50, near_constant, u > 3 AS u_positive FROM k JOIN a USING (feature) JOIN e USING (feature)")
def evidence_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence tables joined to the features, ranked, averaged and flagged; the audit of the features joins last."""
    long = embedding_long(spark, sf_dir)
    evidence = {"u": S.mann_whitney(long, _positive(), p_values=False).select("feature", F.abs("z").alias("u")), "d": S.cohens_d(long, _positive()).select("feature", F.abs("cohens_d").alias("d"))}
    evidence["delta"] = S.mann_whitney(long, _positive(), p_values=False).select("feature", F.abs("cliffs_delta").alias("delta"))
    features = long.select("feature").distinct()
    ranked = rank_evidence(features, evidence, [10, 20, 50])
    audit = feature_audit(long, tolerance=0.2).select("feature", F.col("is_near_constant").alias("near_constant"))
    out = ranked.join(audit, "feature", "left").withColumn("u_positive", F.coalesce(F.col("u") > 3, F.lit(False)))
    return rounded(out.drop("u", "d", "delta"))


_DIFF = f"""{LONG}, c AS (SELECT *, label % 2 AS g FROM long), m AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s, avg(x) FILTER (g = 0) AS mean_0, avg(x) FILTER (g = 1) AS mean_1, var_samp(x) FILTER (g = 0) AS v0, var_samp(x) FILTER (g = 1) AS v1,
  count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1 FROM c GROUP BY feature),
rk AS (SELECT feature, g, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM c), u AS (SELECT feature, sum(r) FILTER (g = 1) AS r1 FROM rk GROUP BY feature),
d AS (SELECT feature, mean_0, mean_1, mean_1 - mean_0 AS mean_difference, (mean_0 - m) / s AS z_mean_0, (mean_1 - m) / s AS z_mean_1, (mean_1 - mean_0) / s AS z_difference, (mean_1 - mean_0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS cohens_d, r1 - n1 * (n1 + 1) / 2.0 AS u FROM m JOIN u USING (feature))"""


@query(f"""WITH {_DIFF} SELECT feature, 'Other' AS category, round(mean_0, 6) AS mean_0, round(mean_1, 6) AS mean_1, round(mean_difference, 6) AS mean_difference, round(z_mean_0, 6) AS z_mean_0, round(z_mean_1, 6) AS z_mean_1, round(z_difference, 6) AS z_difference,
  round(cohens_d, 6) AS cohens_d, round(u, 6) AS u, round(abs(cohens_d), 6) AS abs_cohens_d, round(abs(z_difference), 6) AS abs_z_difference, CASE WHEN z_difference > 0 THEN 'higher_in_cluster_1' WHEN z_difference < 0 THEN 'higher_in_cluster_0' ELSE 'no_difference' END AS direction FROM d""")
def cluster_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = embedding_long(spark, sf_dir).withColumn("cluster", F.col("label") % 2)
    return rounded(S.cluster_differences(long, "cluster", p_values=False))
