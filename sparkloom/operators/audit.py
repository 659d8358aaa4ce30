"""Checks as rows: declare, run in one aggregation a table, and judge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expressions import close


@dataclass(frozen=True)
class Check:
    """A statement on a table: value is an aggregate, and ok a condition on it (a column named value)."""

    stage: str
    name: str
    value: Column
    ok: Column
    expected: str
    severity: str = "fail"


def equals(stage: str, name: str, value: Column, expected: int, severity: str = "fail") -> Check:
    return Check(stage, name, value, F.col("value") == expected, str(expected), severity)


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(stage, check_name, expected, observed, status, severity): all checks of a table in one pass over it."""
    one = df.agg(*[c.value.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("value")) for i in range(len(checks))])
    long = one.select(F.explode(rows).alias("r")).select("r.i", "r.value")
    pick = lambda get: reduce(lambda out, ic: F.when(F.col("i") == ic[0], get(ic[1])).otherwise(out), enumerate(checks), F.lit(None))
    ok = F.coalesce(pick(lambda c: c.ok), F.lit(False))
    severity = pick(lambda c: F.lit(c.severity))
    return long.select(
        pick(lambda c: F.lit(c.stage)).alias("stage"),
        pick(lambda c: F.lit(c.name)).alias("check_name"),
        pick(lambda c: F.lit(c.expected)).alias("expected"),
        F.col("value").alias("observed"),
        F.when(ok, "pass").otherwise(severity).alias("status"),
        severity.alias("severity"),
    )


def status_counts(checks: DataFrame) -> DataFrame:
    """(stage, pass, warning, fail)."""
    return checks.groupBy("stage").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warning", "fail")])


def verdict(checks: DataFrame) -> DataFrame:
    """(n, n_fail, n_warning, verdict)."""
    fails, warns = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warning")
    word = F.when(fails > 0, "FAIL").when(warns > 0, "CONDITIONAL PASS").otherwise("PASS")
    return checks.agg(F.count("*").alias("n"), fails.alias("n_fail"), warns.alias("n_warning"), word.alias("verdict"))


def scan_lines(texts: DataFrame, key: str, text: str, keywords: dict[str, str]) -> DataFrame:
    """(key, line_no, keyword, status): lines that hold a keyword, with the status that the keyword has."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    found = F.filter(F.array(*[F.when(F.lower("line").contains(k.lower()), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())
    status = F.create_map(*[F.lit(x) for pair in keywords.items() for x in pair])
    return lines.select(key, (F.col("at") + 1).alias("line_no"), F.explode(found).alias("keyword")).withColumn("status", status[F.col("keyword")])


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, left, right) where two tables differ, a missing row counting as 0."""
    left, right = a.select(*keys, F.col(value).alias("left")), b.select(*keys, F.col(value).alias("right"))
    out = left.join(right, keys, "full_outer").withColumns({"left": F.coalesce("left", F.lit(0)), "right": F.coalesce("right", F.lit(0))})
    return out.where(F.col("left") != F.col("right"))


#: Keywords of the static scan. Those of splitting and fitting are judged by what surrounds them.
STATIC_KEYWORDS = [
    "fit_transform", "StandardScaler(", "PCA(", "SelectKBest", "SMOTE", "train_test_split", "cross_val_score", "GridSearchCV", "LogisticRegressionCV", "permutation_importance", "GroupKFold", "StratifiedGroupKFold",
    ".groupby(", "id", "ID", "Recording", "sex_male", "gender", "Gender", "class", "Status", "cluster", "stage5_cluster", "stage6_cluster",
]
#: Keywords that need review wherever they stand, unless a line says that they are not used.
REVIEWED = ["SMOTE", "SelectKBest", "cross_val_score", "GridSearchCV"]
FITTED = ["StandardScaler(", "PCA(", "fit_transform"]
LABELS = ["class", "Status", "cluster", "stage5_cluster", "stage6_cluster"]
METADATA = ["sex_male", "gender", "Gender", "Recording", "id", "ID"]
#: Words nearby that show a label column in validation or description, and as a target.
EXCUSES = ["excluded", "not enter", "不进入", "metadata", "required", "post", "crosstab", "assignments", "audit"]
TARGETS = ["y =", "labels", "label"]
#: What shows that a report does not claim a clinical meaning.
GUARDS = ["not a clinical", "not clinical", "cannot", "不能", "不是", "不对应", "不直接", "而非"]


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def classify_static(lines: DataFrame, *, supervised: list[str], aligned: Sequence[str] = (), keywords: list[str] = STATIC_KEYWORDS, near: int = 3, far: int = 12, block: int = 10_000) -> DataFrame:
    """(file, line_no, keyword, status, needs_fix, explanation): the lines (file, line_no, line), numbered from 1 without gaps, that hold a
    keyword, judged by the lines around.

    A split by rows fails unless the line says it is not used. Fitted preprocessing is safe in the supervised files within a pipeline, else a
    warning. A cross-validated model is safe near a pipeline. Label columns that stand near a target are a warning unless something nearby
    excuses them; so is stage5_cluster in the aligned files wherever it stands. Neighbours come from windows over blocks of a
    file's lines, each with far lines of the blocks beside it, so a file of any length is dealt to many tasks."""
    if block < far:
        raise ValueError("a block must hold the lines around one")
    at, own = (F.col("line_no") - 1) % block, F.floor((F.col("line_no") - 1) / block)
    blocks = F.array_compact(F.array(own, F.when(at < far, own - 1), F.when(at >= block - far, own + 1)))
    spread = lines.select("file", "line_no", "line", own.alias("own"), F.explode(blocks).alias("block"))
    w = Window.partitionBy("file", "block").orderBy("line_no")
    around = lambda r: F.array_join(F.collect_list("line").over(w.rowsBetween(-r, r)), "\n")
    hits = F.filter(F.array(*[F.when(F.col("line").contains(k), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())
    rows = spread.select("file", "line_no", "own", "block", F.trim("line").alias("line"), F.lower(around(near)).alias("near"), around(far).alias("far"), hits.alias("hits"))
    rows = rows.where((F.size("hits") > 0) & (F.col("own") == F.col("block"))).withColumn("keyword", F.explode("hits"))
    k, line, refused = F.col("keyword"), F.col("line"), F.col("line").startswith("- No")
    piped = (k == "PCA(") | line.contains("Pipeline") | line.contains("scaler")
    fitted, excused = F.col("file").isin(supervised), _any(F.col("near"), EXCUSES)
    #: The first case that holds: what it is, its status, and why.
    cases = [
        (k.isin(REVIEWED) & ~refused, "warning", "stands outside a refusal: see that it is used within folds only"),
        ((k == "train_test_split") & ~refused & ~line.contains("No row-wise random"), "fail", "a split by rows parts the records of a subject"),
        (k.isin(REVIEWED) | (k == "train_test_split"), "safe", "the line says that it is not used"),
        (k.isin(FITTED) & fitted & piped, "safe", "scaling is part of a pipeline, or there are no components"),
        (k.isin(FITTED) & fitted, "warning", "see that it is fitted to training folds only"),
        (k.isin(FITTED), "warning", "fitted to all rows: fit for description, not for supervised folds"),
        ((k == "LogisticRegressionCV") & F.col("far").contains("Pipeline"), "safe", "searched within a fold's pipeline"),
        (k == "LogisticRegressionCV", "warning", "see that it is searched within a fold's pipeline"),
        (k.isin(LABELS + METADATA) & excused, "safe", "a label or metadata column in validation, exclusion or description"),
        ((k == "stage5_cluster") & F.col("file").isin(list(aligned)), "warning", "earlier clusters are aligned with later ones: see that they are no inputs"),
        (k.isin(LABELS) & _any(F.col("near"), TARGETS), "warning", "a label as a target: see that it is in no feature matrix"),
        (F.lit(True), "safe", "an occurrence that shows no leak by itself"),
    ]
    verdict = F.coalesce(*[F.when(when, F.struct(F.lit(status).alias("status"), F.lit(why).alias("explanation"))) for when, status, why in cases])
    judged = rows.select("file", "line_no", "keyword", verdict.alias("v"))
    return judged.select("file", "line_no", "keyword", "v.status", F.when(F.col("v.status") == "fail", "yes").otherwise("no").alias("needs_fix"), "v.explanation")


def report_boundary(reports: DataFrame, phrase: str, terms: list[str], guards: list[str] = GUARDS) -> DataFrame:
    """(file, check_name, observed, status) of reports (file, text): whether each names its classifier by the phrase, uses a term
    without a guard, or holds replacement characters."""
    lower = F.lower("text")
    named, used = lower.contains(phrase.lower()), F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(lower, t))
    broken = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    rows = [
        ("names the classifier", F.when(named, "found").otherwise("missing"), F.when(named, "pass").otherwise("warning")),
        ("no unguarded terms", F.when(F.size(used) > 0, F.array_join(used, "; ")).otherwise("none"), F.when((F.size(used) == 0) | _any(F.col("text"), guards), "pass").otherwise("fail")),
        ("replacement characters", broken.cast("string"), F.when(broken > 0, "warning").otherwise("pass")),
    ]
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), o.alias("observed"), s.alias("status")) for n, o, s in rows])
    return reports.select("file", F.explode(checks).alias("c")).select("file", "c.*")


def table_suite(stage: str, columns: list[str], key: str, *, n_rows: int | None = None, n_keys: int | None = None) -> list[Check]:
    """Checks of a prepared table: its rows and subjects, missing values, and rows that are repeated as a whole."""
    out = [Check(stage, f"missing {c}", F.count_if(F.col(c).isNull()), F.col("value") == 0, "0") for c in columns]
    hashed = F.xxhash64(*columns)
    out.append(Check(stage, "repeated rows", F.count("*") - F.count_distinct(hashed), F.col("value") == 0, "0", "warning"))
    if n_rows is not None:
        out.append(equals(stage, "rows", F.count("*"), n_rows))
    if n_keys is not None:
        out.append(equals(stage, "subjects", F.count_distinct(key), n_keys))
    return out


def summary_suite(given: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """(n, n_differing, status): a published summary against the same recomputed; missing equals missing."""
    left, right = given.select(*keys, F.col(value).alias("a")), again.select(*keys, F.col(value).alias("b"))
    off = left.join(right, keys, "full_outer").agg(F.count("*").alias("n"), F.count_if(~close(F.col("a"), F.col("b"), tolerance)).alias("n_differing"))
    return off.withColumn("status", F.when(F.col("n_differing") == 0, "pass").otherwise("fail"))


def fold_suite(stage: str, k: int) -> list[Check]:
    """Checks of a fold audit: as many folds as declared, none with a subject on both sides, each with both classes in its test."""
    return [
        equals(stage, "folds", F.count("*"), k),
        equals(stage, "subjects on both sides", F.sum("overlap"), 0),
        Check(stage, "test folds of one class", F.count_if((F.col("test_positive") == 0) | (F.col("test_positive") == F.col("test_subjects"))), F.col("value") == 0, "0"),
    ]


def ranking_suite(stage: str, n: int, ranks: list[str]) -> list[Check]:
    """Checks of a ranking: its rows, places without gaps, ranks within bounds and in the order of mean_rank."""
    inside = F.lit(True)
    for r in ranks:
        inside = inside & F.coalesce(F.col(r).between(1, n), F.lit(True))
    return [
        equals(stage, "rows", F.count("*"), n),
        Check(stage, "places", F.count_distinct("place") - F.max("place"), F.col("value") == 0, "0"),
        Check(stage, "ranks out of bounds", F.count_if(~inside), F.col("value") == 0, "0"),
    ]


def cluster_suite(stage: str, k: int, n: int, least: int) -> list[Check]:
    """Checks of an assignment table (id, cluster, cluster_size): subjects, clusters, repeated ids and small clusters (a warning)."""
    return [
        equals(stage, "subjects", F.count("*"), n),
        equals(stage, "clusters", F.count_distinct("cluster"), k),
        Check(stage, "repeated ids", F.count("*") - F.count_distinct("id"), F.col("value") == 0, "0"),
        Check(stage, f"clusters under {least}", F.count_distinct(F.when(F.col("cluster_size") < least, F.col("cluster"))), F.col("value") == 0, "0", "warning"),
    ]
