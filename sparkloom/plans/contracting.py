"""Queries: input contracts, projections, sets, rankings and audit suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import NAME_CATEGORIES, close, first_match, minmax, minus_log10, verdict
from sparkloom.operators import audit as A
from sparkloom.operators import contracts as K
from sparkloom.operators import describe as D
from sparkloom.operators import metrics as M
from sparkloom.operators import partitions as P
from sparkloom.operators import selection as S
from sparkloom.operators.ranking import top_n_each
from sparkloom.plans.registry import FEATURES, LONG, RECORDS, embedding_long, query, records, rounded, table
from sparkloom.sources.tables import read_checked, require_files

LINES = K.Dataset("lines", key="l_orderkey", label="l_returnflag", recording="l_linenumber", extra=("l_partkey", "l_suppkey"))
_META = ", ".join(f"'{c}'" for c in sorted(LINES.metadata))


@query(f"SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name NOT IN ({_META})")
def allowed_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = K.allowed_features(table(spark, sf_dir, "lineitem"), LINES.metadata, expected=4)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(f"""WITH {RECORDS} SELECT id, recording, 'features_only' AS feature_set, 4 AS n_features, round(quantity + extendedprice + discount + tax, 6) AS total FROM records
UNION ALL SELECT id, recording, 'features_plus_covariate', 5, round(quantity + extendedprice + discount + tax + y, 6) FROM records""")
def feature_set_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature set as a vector of each record, and its sum."""
    rows, sets = records(spark, sf_dir), K.feature_sets(FEATURES, "y")
    vectors = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.array(*[F.col(c).cast("double") for c in own]).alias("v")) for n, own in sets.items()])
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x)
    each = rows.select("id", "recording", F.explode(vectors).alias("s")).select("id", "recording", "s.*")
    return rounded(each.select("id", "recording", "feature_set", F.size("v").alias("n_features"), total.alias("total")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    counts = orders.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("f")).first()
    return K.cohort(orders, "y", 1, expected=counts["f"], total=counts["n"]).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) FILTER (l_orderkey IS NULL) AS n_null, count(*) - count(DISTINCT l_orderkey) AS n_duplicate FROM lineitem")
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.key_audit(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def matched_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return K.join_all(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def checked_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's inputs: the files are there, and the table keeps its contract."""
    require_files(spark, [f"{sf_dir}/{t}.parquet" for t in ("events", "labels")])
    events = read_checked(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "event_type", "value"], key="event_id", constant=["user_id"])
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


_CUST, _BUY = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))


@query(f"""WITH a AS (SELECT DISTINCT k FROM ({_CUST})), b AS (SELECT DISTINCT k FROM ({_BUY})), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(x) AS n_a, count(y) AS n_b, count(*) FILTER (x = y) AS n_both, count(*) FILTER (y IS NULL) AS n_only_a, count(*) FILTER (x IS NULL) AS n_only_b, count(*) AS n_union, count(*) = count(*) FILTER (x = y) AS equal FROM j""")
def id_set_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_relation(*_sides(spark, sf_dir), "k")


@query(f"({_CUST}) INTERSECT ({_BUY})")
def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_members(*_sides(spark, sf_dir), "k", "both")


@query(f"({_CUST}) EXCEPT ({_BUY})")
def id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_members(*_sides(spark, sf_dir), "k", "left")


@query(f"({_CUST}) UNION ({_BUY})")
def id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_members(*_sides(spark, sf_dir), "k", "any")


@query("SELECT CAST(20 AS BIGINT) AS n, CAST(20 AS BIGINT) AS n_equal, true AS equal")
def ranked_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the 50 dearest parts begin with the 20 dearest ones, each ranked by itself."""
    parts = table(spark, sf_dir, "part").select(F.lit(0).alias("all"), "p_partkey", "p_retailprice")
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return K.same_prefix(top_n_each(parts, ["all"], order, 50), top_n_each(parts, ["all"], order, 20), "place", "p_partkey")


_DISP = f"{LONG}, d AS (SELECT feature, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(mad(x), 6) AS mad FROM long GROUP BY feature)"


@query(f"WITH {_DISP} SELECT feature, row_number() OVER (ORDER BY iqr DESC, feature DESC) AS place, iqr, mad FROM d QUALIFY place <= 10")
def top_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_dispersion(rounded(D.median_deviation(embedding_long(spark, sf_dir), ["feature"])), "iqr", 10)


_CAND = "SELECT p_brand || ' | ' || p_size || ' | pca_' || (p_size % 7) AS candidate_id, p_partkey, p_size % 7 AS n_components, lower(CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END) = 'true' AS eligible FROM part"


@query(f"SELECT candidate_id, p_partkey, n_components, eligible FROM ({_CAND}) WHERE candidate_id IN (SELECT candidate_id FROM ({_CAND}) WHERE eligible AND p_partkey <= 50)")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates found again by their composite key."""
    parts = table(spark, sf_dir, "part").withColumn("representation", F.concat(F.lit("pca_"), F.col("p_size") % 7))
    said = F.when(F.col("p_size") % 2 == 0, "True").otherwise("False")
    rows = parts.select(K.candidate_id("p_brand", "p_size", "representation").alias("candidate_id"), "p_partkey", K.component_count(F.col("representation")).alias("n_components"), K.truth(said).alias("eligible"))
    return rows.join(rows.where("eligible and p_partkey <= 50").select("candidate_id"), "candidate_id", "left_semi")


_FEATURE_NAMES = ["tqwt_entropy_1", "Ed_2nd", "locPctJitter", "apq3Shimmer", "meanHarmToNoise", "minIntensity", "f1", "b4", "mean_MFCC_2nd", "std_7th_delta", "RPDE", "numPulses", "Jitter_shim_apq", "f11"]
_CASE = " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{c}'" for c, p in NAME_CATEGORIES)


@query(f"SELECT name, CASE {_CASE} ELSE 'Other' END AS category FROM (VALUES " + ", ".join(f"('{n}')" for n in _FEATURE_NAMES) + ") t(name)")
def feature_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven categories of feature names."""
    names = spark.createDataFrame([(n,) for n in _FEATURE_NAMES], "name string")
    return names.select("name", first_match(F.col("name")).alias("category"))


@query("""WITH e AS (SELECT p_partkey, p_brand, p_size / 50.0 AS x, p_size % 5 <> 0 AS ok, CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size / 100.0 END AS q FROM part),
w AS (SELECT *, min(x) FILTER (ok) OVER () AS lo, max(x) FILTER (ok) OVER () AS hi, min(q) FILTER (q > 0) OVER () AS least FROM e)
SELECT p_partkey, CASE WHEN x >= 0.6 THEN 'strong' WHEN x >= 0.3 THEN 'moderate' ELSE 'weak' END AS verdict, CASE WHEN ok THEN round((x - lo) / (hi - lo), 6) END AS scaled, round(-log10(CASE WHEN q = 0 THEN least ELSE q END), 6) AS minus_log10_q,
  abs(x - q) <= 0.1 AS near FROM w""")
def thresholds_and_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, everything = F.col("p_size"), Window.partitionBy()
    e = table(spark, sf_dir, "part").select("p_partkey", (size / 50.0).alias("x"), (size % 5 != 0).alias("ok"), F.when(size % 11 == 0, 0.0).otherwise(size / 100.0).alias("q"))
    out = e.select("p_partkey", verdict(F.col("x")).alias("verdict"), minmax(F.col("x"), within=F.col("ok")).alias("scaled"), minus_log10(F.col("q"), everything).alias("minus_log10_q"), close(F.col("x"), F.col("q"), 0.1).alias("near"))
    return rounded(out)


@query(f"""WITH {LONG}, a AS (SELECT feature, stddev_pop(x) AS std, count(DISTINCT x) AS k, count(*) FILTER (x IS NULL) AS m FROM long GROUP BY feature)
SELECT count(*) AS n_features, CAST(sum(m) AS BIGINT) AS n_missing, count(*) FILTER (k <= 1) AS n_constant, count(*) FILTER (std <= 0.2) AS n_near_constant, coalesce(string_agg(CASE WHEN std <= 0.2 THEN feature END, '; ' ORDER BY feature), '') AS flagged FROM a""")
def feature_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all features as one row, with the names of those that hardly vary."""
    return D.audit_summary(D.feature_audit(embedding_long(spark, sf_dir), tolerance=0.2))


@query(f"WITH {RECORDS} SELECT y, count(*) AS n_subjects, CAST(sum(r) AS BIGINT) AS n_records FROM (SELECT id, min(y) AS y, count(*) AS r FROM records GROUP BY id) GROUP BY y")
def subject_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.label_distribution(records(spark, sf_dir), "id", "y")


@query("SELECT p_brand, round(avg(p_size), 6) AS mean_size, round(avg(p_retailprice), 6) AS mean_price, count(*) AS n, string_agg(DISTINCT split_part(p_type, ' ', 1), '; ' ORDER BY split_part(p_type, ' ', 1)) AS kinds FROM part GROUP BY p_brand")
def group_means_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.sort_array(F.collect_set(F.substring_index("p_type", " ", 1))), "; ")
    return rounded(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("mean_size"), F.avg("p_retailprice").alias("mean_price"), F.count("*").alias("n"), kinds.alias("kinds")))


@query("WITH r AS (SELECT split_part(p_type, ' ', 1) AS category FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) SELECT category, count(*) AS n FROM r GROUP BY category")
def top_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.operators.reports import category_counts

    parts = table(spark, sf_dir, "part").withColumn("category", F.substring_index("p_type", " ", 1))
    return category_counts(parts, 50, [F.desc("p_retailprice"), F.asc("p_partkey")])


@query("SELECT event_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, 'value' AS metric FROM (SELECT event_type, user_id % 5 AS fold, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def fold_summary_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("value"))
    return rounded(M.fold_summary(per, ["event_type"], ["value"], sample=False))


@query("SELECT count(DISTINCT event_type) AS n, CAST(0 AS BIGINT) AS n_differing, 'pass' AS status FROM events")
def summary_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary against the same one from sums and counts."""
    events = table(spark, sf_dir, "events")
    given = events.groupBy("event_type").agg(F.avg("value").alias("v"))
    again = events.groupBy("event_type").agg((F.sum("value") / F.count("value")).alias("v"))
    return A.summary_suite(given, again, ["event_type"], "v", 1e-9)


@query("WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT vec_id, e.label, n AS size, round(n / (SELECT count(*) FROM embeddings), 6) AS ratio FROM embeddings e JOIN g USING (label)")
def group_size_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rounded(rows.join(F.broadcast(P.group_shares(rows, "label")), "label"))


@query("""WITH p AS (SELECT label % 2 AS a, label % 6 AS b FROM embeddings), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT b, a AS c FROM n QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC, a) = 1), q AS (SELECT a, c, CAST(count(*) AS DOUBLE) AS n FROM p JOIN m USING (b) GROUP BY ALL),
t AS (SELECT sum(n) AS t FROM q), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM q) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM q GROUP BY a)) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM q GROUP BY c)) AS y)
SELECT CAST(t AS BIGINT) AS n, round(CASE WHEN (x + y) / 2 = x * y / (t * (t - 1) / 2) THEN 1 ELSE (ab - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)) END, 6) AS collapsed_ari FROM s, t""")
def collapsed_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the finer partition agrees with the coarser when each fine cluster becomes its most frequent coarse one."""
    two, six = (F.col("label") % 2).cast("int"), (F.col("label") % 6).cast("int")
    return rounded(P.collapsed_agreement(table(spark, sf_dir, "embeddings").select(two.alias("two"), six.alias("six")), "two", "six"))


_LINE_CHECKS = "SELECT 'raw' AS stage, check_name, CAST(observed AS DOUBLE) AS observed, CASE WHEN observed = expected THEN 'pass' ELSE severity END AS status FROM ({}) t(check_name, observed, expected, severity)"


@query(_LINE_CHECKS.format("""SELECT 'missing ' || c, 0, 0, 'fail' FROM (VALUES ('l_orderkey'), ('l_linenumber'), ('l_quantity')) v(c) UNION ALL SELECT 'repeated rows', count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_quantity)), 0, 'warning' FROM lineitem
UNION ALL SELECT 'rows', count(*), count(*), 'fail' FROM lineitem UNION ALL SELECT 'subjects', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey), 'fail' FROM lineitem"""))
def prepared_table_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    n = lines.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("k")).first()
    checks = A.table_suite("raw", ["l_orderkey", "l_linenumber", "l_quantity"], "l_orderkey", n_rows=n["n"], n_keys=n["k"])
    return A.run_checks(lines, checks).select("stage", "check_name", "observed", "status")


@query("SELECT 'cv' AS stage, c AS check_name, CAST(o AS DOUBLE) AS observed, 'pass' AS status FROM (VALUES ('folds', 5), ('subjects on both sides', 0), ('test folds of one class', 0)) t(c, o)")
def fold_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = records(spark, sf_dir).groupBy("id").agg(F.min("y").alias("y"))
    own = records(spark, sf_dir).join(M.stratified_folds(subjects, "id", "y").select("id", "fold"), "id")
    return A.run_checks(M.fold_audit(own, "id", "y"), A.fold_suite("cv", 5)).select("stage", "check_name", "observed", "status")


@query("SELECT 'ranking' AS stage, c AS check_name, CAST(o AS DOUBLE) AS observed, 'pass' AS status FROM (VALUES ('rows', 64), ('places', 0), ('ranks out of bounds', 0)) t(c, o)")
def ranking_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.plans.testing import evidence_ranks

    return A.run_checks(evidence_ranks(spark, sf_dir), A.ranking_suite("ranking", 64, ["rank_u", "rank_d", "rank_delta"])).select("stage", "check_name", "observed", "status")


def _clusters(k: int) -> str:
    return f"""WITH a AS (SELECT vec_id AS id, label % {k} AS cluster, count(*) OVER (PARTITION BY label % {k}) AS size FROM embeddings)
SELECT 'k{k}' AS stage, check_name, CAST(observed AS DOUBLE) AS observed, CASE WHEN observed = expected THEN 'pass' ELSE severity END AS status FROM (SELECT 'subjects', count(*), count(*), 'fail' FROM a UNION ALL SELECT 'clusters', count(DISTINCT cluster), {k}, 'fail' FROM a
UNION ALL SELECT 'repeated ids', count(*) - count(DISTINCT id), 0, 'fail' FROM a UNION ALL SELECT 'clusters under 60', count(DISTINCT cluster) FILTER (size < 60), 0, 'warning' FROM a) t(check_name, observed, expected, severity)"""


def _cluster_suite(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % k).alias("cluster"))
    a = rows.join(F.broadcast(rows.groupBy("cluster").agg(F.count("*").alias("cluster_size"))), "cluster")
    return A.run_checks(a, A.cluster_suite(f"k{k}", k, rows.count(), 60)).select("stage", "check_name", "observed", "status")


@query(_clusters(2))
def cluster_suite_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster_suite(spark, sf_dir, 2)


@query(_clusters(6))
def cluster_suite_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster_suite(spark, sf_dir, 6)


@query("SELECT stage, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'fail') AS fail FROM (" + _clusters(6) + ") GROUP BY stage")
def suite_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_counts(cluster_suite_6(spark, sf_dir))


_TERMS = ["tremor", "token", "the"]


@query("""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS file, text, lower(text) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, list_filter(['tremor', 'token', 'the'], lambda t: contains(l, t)) AS used, contains(text, 'cannot') OR contains(text, 'not a clinical') OR contains(text, 'not clinical') OR contains(text, '不能') OR contains(text, '不是') OR contains(text, '不对应') OR contains(text, '不直接') OR contains(text, '而非') AS guarded, length(text) - length(replace(text, chr(65533), '')) AS broken FROM r)
SELECT file, 'names the classifier' AS check_name, CASE WHEN contains(l, 'license') THEN 'found' ELSE 'missing' END AS observed, CASE WHEN contains(l, 'license') THEN 'pass' ELSE 'warning' END AS status FROM u
UNION ALL SELECT file, 'no unguarded terms', CASE WHEN len(used) > 0 THEN array_to_string(used, '; ') ELSE 'none' END, CASE WHEN len(used) = 0 OR guarded THEN 'pass' ELSE 'fail' END FROM u
UNION ALL SELECT file, 'replacement characters', CAST(broken AS VARCHAR), CASE WHEN broken > 0 THEN 'warning' ELSE 'pass' END FROM u""")
def report_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file"), "text")
    return A.report_boundary(reports, "License", _TERMS)
