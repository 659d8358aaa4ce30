"""Queries: feature schemes, cluster profiles and the static scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import audit as A
from sparkloom.operators import partitions as P
from sparkloom.operators import reports as R
from sparkloom.operators import selection as S
from sparkloom.plans.registry import LONG, embedding_long, embedding_points, query, rounded, table

NAMES = [f"f{i:02d}" for i in range(64)]
_KINDS = ["MFCC", "TQWT", "Shimmer"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_points(spark, sf_dir).select(*[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(NAMES)])


def _schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = spark.createDataFrame([(n, i + 1) for i, n in enumerate(NAMES)], "feature string, place int")
    return S.feature_schemes(_wide(spark, sf_dir), NAMES, ranked)


@query()
def feature_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the twelve schemes, with their place and dispersion."""
    return _schemes(spark, sf_dir)


@query()
def scheme_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scheme_audit(_schemes(spark, sf_dir))


_TOPS = f"""{LONG}, o AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY feature), z AS (SELECT feature, label % 6 AS cluster, (avg(x) - any_value(m)) / any_value(s) AS z FROM long JOIN o USING (feature) GROUP BY feature, label % 6),
c AS (SELECT feature, cluster, z - (sum(z) OVER (PARTITION BY feature) - z) / 5 AS contrast FROM z), t AS (SELECT *, ['MFCC', 'TQWT', 'Shimmer'][feature % 3 + 1] AS category FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(abs(contrast), 9) DESC, feature) <= 10)"""


@query(f"""WITH {_TOPS}, m AS (SELECT label % 6 AS cluster, label % 2 AS sex FROM embeddings), n AS (SELECT cluster, count(*) AS n FROM m GROUP BY cluster),
d AS (SELECT cluster, string_agg(sex || ':' || n, '; ' ORDER BY sex) AS sex_distribution FROM (SELECT cluster, sex, count(*) AS n FROM m GROUP BY ALL) GROUP BY cluster),
k AS (SELECT cluster, string_agg(category || ':' || n, '; ' ORDER BY n DESC, category) AS dominant_categories FROM (SELECT cluster, category, count(*) AS n FROM t GROUP BY ALL) GROUP BY cluster),
p AS (SELECT cluster, string_agg(CAST(feature AS VARCHAR), '; ' ORDER BY round(contrast, 9) DESC, feature) AS top_positive FROM (SELECT * FROM t WHERE contrast >= 0 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(abs(contrast), 9) DESC, feature) <= 5) GROUP BY cluster),
g AS (SELECT cluster, string_agg(CAST(feature AS VARCHAR), '; ' ORDER BY round(abs(contrast), 9) DESC, feature) AS top_negative FROM (SELECT * FROM t WHERE contrast < 0 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(abs(contrast), 9) DESC, feature) <= 5) GROUP BY cluster)
SELECT cluster, n AS n_members, round(n / (SELECT count(*) FROM m), 6) AS ratio, dominant_categories, top_positive, top_negative, sex_distribution FROM n JOIN d USING (cluster) JOIN k USING (cluster) JOIN p USING (cluster) JOIN g USING (cluster)""")
def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets each of six clusters apart, in words."""
    long = embedding_long(spark, sf_dir).withColumn("cluster", F.col("label") % 6)
    category = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("feature") % 3 + 1).cast("int"))
    tops = P.contrasts(long, "cluster").select("cluster", "feature", category.alias("category"), "contrast")
    members = table(spark, sf_dir, "embeddings").select((F.col("label") % 6).alias("cluster"), (F.col("label") % 2).alias("sex"))
    return rounded(R.cluster_profiles(members, tops, "cluster", ["sex"]).drop("phenotype"))


def _held(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _in(words: list[str]) -> str:
    return "k IN (" + ", ".join(f"'{w}'" for w in words) + ")"


_AROUND = "string_agg(line, chr(10)) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
_REFUSED = "starts_with(line, '- No')"
_STATIC = f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
w AS (SELECT file, line_no, line AS whole, trim(line) AS line, lower({_AROUND.format(n=3)}) AS near, {_AROUND.format(n=12)} AS far FROM l),
h AS (SELECT * FROM w, (SELECT unnest([{', '.join(f"'{k}'" for k in A.STATIC_KEYWORDS)}]) AS k) WHERE contains(whole, k)),
v AS (SELECT file, line_no, k AS keyword, CASE WHEN {_in(A.REVIEWED)} THEN CASE WHEN {_REFUSED} THEN 'safe' ELSE 'warning' END
  WHEN k = 'train_test_split' THEN CASE WHEN {_REFUSED} OR contains(line, 'No row-wise random') THEN 'safe' ELSE 'fail' END
  WHEN {_in(A.FITTED)} THEN CASE WHEN file IN ('1', '2') AND (k = 'PCA(' OR contains(line, 'Pipeline') OR contains(line, 'scaler')) THEN 'safe' ELSE 'warning' END
  WHEN k = 'LogisticRegressionCV' THEN CASE WHEN contains(far, 'Pipeline') THEN 'safe' ELSE 'warning' END
  WHEN {_in(A.LABELS + A.METADATA)} AND {_held('near', A.EXCUSES)} THEN 'safe'
  WHEN k = 'stage5_cluster' AND file = '3' THEN 'warning'
  WHEN {_in(A.LABELS)} AND {_held('near', A.TARGETS)} THEN 'warning' ELSE 'safe' END AS status FROM h)
SELECT *, CASE WHEN status = 'fail' THEN 'yes' ELSE 'no' END AS needs_fix FROM v"""


@query(_STATIC)
def static_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of the static scan in the lines of all documents, each judged by the lines around it."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = A.classify_static(lines.select("file", (F.col("at") + 1).alias("line_no"), "line"), supervised=["1", "2"], aligned=["3"])
    return found.drop("explanation")
