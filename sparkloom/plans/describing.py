"""Queries: contracts, description, crosstabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import first_match, share, warnings
from sparkloom.operators import describe as D
from sparkloom.operators.partitions import group_shares
from sparkloom.plans.registry import FEATURES, LONG, RECORDS, embedding_long, query, records, rounded, table

_FEATURE_ROWS = "UNPIVOT (SELECT id, y, quantity, extendedprice, discount, tax FROM records) ON quantity, extendedprice, discount, tax INTO NAME feature VALUE x"
_STATS = """count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std, round(quantile_cont(x, 0.5), 8) AS median, round(min(x), 8) AS min, round(max(x), 8) AS max,
  round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 8) AS iqr"""


@query(f"WITH {RECORDS} SELECT id, min(y) AS y, count(*) AS record_count, " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES) + " FROM records GROUP BY id")
def subject_mean_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.subject_table(records(spark, sf_dir), "id", FEATURES, ["y"]))


@query(f"""WITH {RECORDS}, rows AS ({_FEATURE_ROWS})
SELECT 'overall' AS scope, 'all' AS label, feature, {_STATS} FROM rows GROUP BY feature
UNION ALL SELECT 'label', CAST(y AS VARCHAR), feature, {_STATS} FROM rows GROUP BY y, feature""")
def describe_overall_and_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.describe_with_total(D.to_long(records(spark, sf_dir), ["id", "y"], FEATURES), "y"), 8)


@query(f"""WITH {RECORDS}, s AS (SELECT id, min(y) AS y, avg(quantity) AS quantity, avg(extendedprice) AS extendedprice, avg(discount) AS discount, avg(tax) AS tax FROM records GROUP BY id),
rows AS ({_FEATURE_ROWS.replace('FROM records', 'FROM s')})
SELECT 'overall' AS scope, 'all' AS label, feature, {_STATS} FROM rows GROUP BY feature
UNION ALL SELECT 'label', CAST(y AS VARCHAR), feature, {_STATS} FROM rows GROUP BY y, feature""")
def describe_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = D.subject_table(records(spark, sf_dir), "id", FEATURES, ["y"])
    return rounded(D.describe_with_total(D.to_long(subjects, ["id", "y"], FEATURES), "y"), 8)


_CELLS = 'count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1"'


@query(f"SELECT coalesce(CAST(quality AS VARCHAR), 'All') AS quality, {_CELLS}, count(*) AS \"All\" FROM labels GROUP BY ROLLUP (quality)")
def crosstab_with_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.crosstab(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1], margins=True)


@query(f"SELECT CAST(quality AS VARCHAR) AS quality, {_CELLS} FROM labels GROUP BY quality")
def crosstab_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.crosstab(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("SELECT DISTINCT text, lang, source FROM documents")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text", "lang", "source").dropDuplicates()


@query("SELECT count(*) AS n_rows, count(DISTINCT (text, lang)) AS n_distinct, count(*) - count(DISTINCT (text, lang)) AS n_duplicate FROM documents")
def duplicate_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicates(table(spark, sf_dir, "documents"), ["text", "lang"])


_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL{' OR isnan(value)' if c == 'value' else ''}) AS n_missing FROM events" for c in _EVENTS))
def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.null_census(table(spark, sf_dir, "events").select(*_EVENTS))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def records_per_subject_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.size_distribution(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT count(*) AS groups, count(*) FILTER (k > 1) AS conflicting FROM (SELECT count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_orderkey)")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""SELECT complete, count(*) AS n FROM (SELECT list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS complete FROM lineitem GROUP BY l_orderkey) GROUP BY complete""")
def recording_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long"))).alias("r"), F.count("*").alias("n"))
    return per.select((F.col("r") == F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("complete")).groupBy("complete").agg(F.count("*").alias("n"))


@query("SELECT doc_id, toxic, 1 - toxic AS covariate FROM labels")
def recode_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", (1 - F.col("toxic")).alias("covariate"))


_TYPES = [("Brass", "brass"), ("Steel", "steel"), ("Copper", "copper"), ("Tin", "tin"), ("Nickel", "nickel")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type), '{p}') THEN '{c}'" for c, p in _TYPES) + " ELSE 'Other' END AS category FROM part")
def categorize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", first_match(F.col("p_type"), _TYPES).alias("category"))


@query("""WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), s AS (SELECT *, n / sum(n) OVER () AS r FROM g)
SELECT p_brand, n, round(r, 6) AS ratio, r >= 0.04 AND n >= 8 AS eligible,
  concat_ws('; ', CASE WHEN r < 0.04 THEN 'small share' END, CASE WHEN n < 8 THEN 'few rows' END) AS warning FROM s""")
def eligibility_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = group_shares(table(spark, sf_dir, "part"), "p_brand").withColumnRenamed("size", "n")
    few, small = F.col("n") < 8, F.col("ratio") < 0.04
    return rounded(s.select("p_brand", "n", "ratio", (~few & ~small).alias("eligible"), warnings((small, "small share"), (few, "few rows")).alias("warning")))


@query(f"""WITH {LONG} SELECT feature, count(*) AS n, count(*) FILTER (x IS NULL) AS n_missing, count(DISTINCT x) AS n_distinct, round(stddev_pop(x), 6) AS std,
  count(DISTINCT x) <= 1 AS is_constant, stddev_pop(x) <= 1e-12 AS is_near_constant FROM long GROUP BY feature""")
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.feature_audit(embedding_long(spark, sf_dir)))


@query(f"""WITH {LONG} SELECT feature, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(mad(x), 6) AS mad FROM long GROUP BY feature""")
def iqr_mad_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.median_deviation(embedding_long(spark, sf_dir), ["feature"]))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rounded(counts.withColumn("percent", 100.0 * share(F.col("n"), F.sum("n").over(Window.partitionBy()))))
