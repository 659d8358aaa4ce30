"""Helpers shared by the text operators: words, grams, stored intermediates, small joins, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from sparkloom.sources.shared import discard, folder_for, scratch, shared_dir, stored  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A lower-cased word of letters, digits and anything outside ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in order; a null text has none."""
    gap = f"[{pattern[2:-2]}]+"
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same to pure ASCII text, and faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row although body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(items: Column, k: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine() over each run of k neighbours, built by doubling; the array is empty if it is shorter.
    combine must be associative in effect: a run is folded half by half, always in the same way."""

    def pair(a: Column, b: Column, skip: int, length: Column) -> Column:
        length = F.greatest(length, F.lit(0))
        return F.zip_with(F.slice(a, 1, length), F.slice(b, skip + 1, length), combine)

    def build(base: Column, width: int) -> Column:
        if width == 1:
            return base
        half = width // 2
        if width % 2 == 0:
            return let(build(base, half), lambda p: pair(p, p, half, F.size(p) - half))
        return let(build(base, width - 1), lambda q: pair(q, base, width - 1, F.size(base) - (width - 1)))

    return let(items, lambda base: build(base, k))


def grams(items: Column, k: int) -> Column:
    """A 64-bit hash of each run of k neighbouring elements."""
    return hashed_runs(F.transform(items, lambda x: F.xxhash64(x)), k)


def hashed_runs(hashes: Column, k: int) -> Column:
    """grams() of elements that are hashes already."""
    return runs(hashes, k, lambda a, b: F.xxhash64(a, b))


def covered(starts: Column, width: int) -> Column:
    """How many positions the runs [start, start + width) cover; starts are sorted and distinct."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.aggregate(
            runs(starts, 2, lambda a, b: F.least(b - a, F.lit(width))),
            F.lit(width),
            lambda total, step: total + step,
        )
    )


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from those taken."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def _width(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        size = F.coalesce(F.size(value), F.lit(0))
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16), lambda t, x: t + _width(x, kind.elementType).cast("int"))
        return 8 * size + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Marks a stored table for broadcast if it has max_rows rows and, by the lengths of its values, max_bytes bytes at
    most; else Spark shuffles it."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    bytes_ = df.agg(F.sum(sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if bytes_ <= max_bytes else df


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, hot: int = 1000) -> DataFrame:
    """rows joined (inner) with keyed, a stored table with one row for each key and the number n of rows that have it.

    Keys that have over 1 / hot of all the rows counted, fewer than hot of them, are broadcast; no other key's rows
    are more than a small part of what is shuffled. So a frequent key never meets in one task."""
    total = keyed.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    heavy = keyed.where(F.col(n) * hot > F.lit(total))
    light = keyed.where(F.col(n) * hot <= F.lit(total))
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that they reach from node, itself included.

    Each round joins every node's neighbours to their smallest (large-star), then hangs a node's
    smaller neighbours from the smallest of these (small-star), until each node has one root: it is a root, or one edge ends in it.
    Edges stay distinct and hubs only lose edges, so no group is gathered in one place."""
    pairs = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    for k in range(max_rounds + 1):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("root"))
        of = ends.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        if not of.agg(F.count_if(F.col("root") != F.col("other"))).first()[0]:
            return of.select("node", "root")
        if k == max_rounds:
            break
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        smaller = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(smaller, "b").select(F.col("m").alias("x"), "a", "b")
        pairs = stored(
            hung.select(F.col("x").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(),
            name,
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
