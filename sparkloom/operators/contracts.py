"""What a stage may rely on: datasets, their feature columns, cohorts, keys, joins and sets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Parts of names that mark a label or a cluster, which no feature may have.
LABEL_TOKENS = ("class", "label", "status", "cluster", "target")


@dataclass(frozen=True)
class Dataset:
    """Which columns of a table are what."""

    name: str
    key: str
    label: str
    covariate: str | None = None
    recording: str | None = None
    extra: tuple[str, ...] = field(default_factory=tuple)

    @property
    def metadata(self) -> frozenset[str]:
        return frozenset(c for c in (self.key, self.label, self.covariate, self.recording, *self.extra) if c)


def feature_columns(df: DataFrame, metadata: Iterable[str]) -> list[str]:
    """The numeric columns, in order, that are no metadata."""
    known = set(metadata)
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in known]


def is_forbidden(name: str, metadata: Iterable[str], tokens: Iterable[str] = LABEL_TOKENS) -> bool:
    """Whether a column is metadata or its lower-cased name holds a token of a label."""
    return name in set(metadata) or any(t in name.lower() for t in tokens)


def allowed_features(df: DataFrame, metadata: Iterable[str], expected: int | None = None, tokens: Iterable[str] = LABEL_TOKENS) -> list[str]:
    """The feature columns that are not forbidden; an error if their number is not the expected one."""
    out = [c for c in feature_columns(df, metadata) if not is_forbidden(c, metadata, tokens)]
    if expected is not None and len(out) != expected:
        raise ValueError(f"{len(out)} features where {expected} were expected")
    return out


def feature_sets(features: list[str], covariate: str) -> dict[str, list[str]]:
    """The two sets that models are compared on: the features alone, and with the covariate."""
    return {"features_only": list(features), "features_plus_covariate": [*features, covariate]}


def require(df: DataFrame, **expected: tuple[Column, int]) -> DataFrame:
    """df, if each aggregate of it is what it should be, all computed in one pass; else an error that names all that are not."""
    got = df.agg(*[c.cast("long").alias(n) for n, (c, _) in expected.items()]).first()
    wrong = [f"{n} is {got[n]}, not {want}" for n, (_, want) in expected.items() if got[n] != want]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def cohort(df: DataFrame, label: str, value: int, *, expected: int | None = None, total: int | None = None) -> DataFrame:
    """The rows with a label; an error if they, or all rows, are not as many as expected."""
    counts = {"rows": (F.count("*"), total), "cohort": (F.count_if(F.col(label) == value), expected)}
    require(df, **{k: v for k, v in counts.items() if v[1] is not None})
    return df.where(F.col(label) == value)


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_keys, n_null, n_duplicate): n_duplicate counts the rows whose key an earlier row has."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"),
    )


def join_all(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """left with columns of right by a unique key; an error if any row of left finds none, or right's keys repeat."""
    require(right.groupBy(key).agg(F.count("*").alias("n")), repeated=(F.count_if(F.col("n") > 1), 0))
    lost = left.join(right.select(key), key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows have no match by {key}")
    return left.join(right.select(key, *columns), key, "left")


def set_relation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(n_a, n_b, n_both, n_only_a, n_only_b, n_union, equal) of the distinct values of a column in two tables, null being a value.

    Values meet by one aggregation, so that neither side is broadcast and a value's copies are combined before they move."""
    marked = a.select(column, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(column, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per = marked.groupBy(column).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    both, only_a, only_b = (F.count_if(c) for c in ((F.col("in_a") + F.col("in_b")) == 2, F.col("in_b") == 0, F.col("in_a") == 0))
    return per.agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("n_b"), both.alias("n_both"), only_a.alias("n_only_a"), only_b.alias("n_only_b"),
        F.count("*").alias("n_union"), ((only_a == 0) & (only_b == 0)).alias("equal"),
    )


def set_members(a: DataFrame, b: DataFrame, column: str, which: str) -> DataFrame:
    """(column): the distinct values in both tables ("both"), in the first only ("left") or in any ("any")."""
    x, y = a.select(column), b.select(column)
    return {"both": x.intersect, "left": lambda o: x.subtract(o), "any": lambda o: x.union(o).distinct()}[which](y)


def same_prefix(longer: DataFrame, shorter: DataFrame, place: str, item: str) -> DataFrame:
    """(n, n_equal, equal): whether a ranked list begins as a shorter one does, by place."""
    joined = shorter.select(place, F.col(item).alias("short")).join(longer.select(place, F.col(item).alias("long")), place, "left")
    hits = F.count_if(F.col("short").eqNullSafe(F.col("long")))
    return joined.agg(F.count("*").alias("n"), hits.alias("n_equal"), (hits == F.count("*")).alias("equal"))


def truth(text: Column) -> Column:
    """Whether a text says true, in any case; null and anything else do not."""
    return F.coalesce(F.lower(text.cast("string")) == "true", F.lit(False))


def candidate_id(*parts: str) -> Column:
    """The parts of a composite key as one text."""
    return F.concat_ws(" | ", *[F.col(p).cast("string") for p in parts])


def component_count(name: Column) -> Column:
    """The number at the end of a representation's name, such as 5 in pca_5; null without one."""
    return F.try_element_at(F.split(name, "_"), F.lit(-1)).try_cast("int")
