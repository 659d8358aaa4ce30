"""Reading and writing tables."""

from __future__ import annotations

import csv
import io
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources import csv_blocks
from sparkloom.sources.shared import discard


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, *, banner: bool = False) -> DataFrame:
    """CSV files with a header in their first line, or in a later one below a banner; see csv_blocks.table.

    Columns are taken by the names of each file's header. Quoted commas and line breaks are kept; large files are read by many tasks."""
    return csv_blocks.table(spark, path, StructType.fromDDL(schema) if isinstance(schema, str) else schema, banner=banner)


def find_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The paths of all files of a name anywhere below a folder, in order; an error if there is none.

    Of files with the same name below different folders the first in order comes first, so callers that want one take it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    out = sorted(found.inputFiles())
    if not out:
        raise FileNotFoundError(f"{pattern} below {folder}")
    return out


def read_found(spark: SparkSession, folder: str, pattern: str, schema: StructType | str, *, one: bool = False) -> DataFrame:
    """CSV files of a name anywhere below a folder, all of them or with one the first in order; an error if there is none, or if one is malformed."""
    paths = find_files(spark, folder, pattern)
    return read_csv(spark, paths[:1] if one else paths, schema)


def require_files(spark: SparkSession, paths: list[str]) -> None:
    """An error that names every path that does not exist, wherever Hadoop's file systems reach it."""
    conf, lost = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(conf).exists(target):
            lost.append(path)
    if lost:
        raise FileNotFoundError("missing: " + ", ".join(lost))


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, text): whole text files below a folder; bytes that are not UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, line_no, line): the lines of text files below a folder, numbered from 1 within each."""
    lines = read_texts(spark, path, pattern).select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return lines.select("file", (F.col("at") + 1).alias("line_no"), "line")


def read_checked(spark: SparkSession, path: str, required: list[str], key: str | None = None, constant: list[str] | None = None) -> DataFrame:
    """A Parquet table with its contract: columns there, no nulls or NaN in them, and columns constant within a key."""
    df = spark.read.parquet(path)
    lost = sorted(set(required) - set(df.columns))
    if lost:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    kinds = dict(df.dtypes)
    gap = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in required}
    nulls = df.agg(*[F.count_if(g).alias(c) for c, g in gap.items()]).first()
    bad = [c for c in required if nulls[c]]
    if bad:
        raise ValueError(f"{path} has missing values in {', '.join(bad)}")
    if constant:
        spread = df.groupBy(key).agg(*[(F.min(c) != F.max(c)).alias(c) for c in constant]).agg(*[F.count_if(c).alias(c) for c in constant]).first()
        bad = [c for c in constant if spread[c]]
        if bad:
            raise ValueError(f"{path}: {', '.join(bad)} vary within {key}")
    return df


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _report(df: DataFrame, max_rows: int) -> list:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} rows are no report")
    return rows


def write_csv(df: DataFrame, path: str, *, max_rows: int = 100_000) -> None:
    """A report as one CSV file with a byte order mark and a header; an error beyond max_rows rows. Larger tables are written by
    df.write.csv."""
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(df.columns)
    out.writerows([["" if x is None or x != x else x for x in r] for r in _report(df, max_rows)])
    _put(df.sparkSession, path, ("\ufeff" + text.getvalue()).encode())


def write_crosstab(df: DataFrame, path: str, row: str, column: str) -> None:
    """A crosstab as one CSV file, its first cell naming both axes."""
    write_csv(df.select(F.col(row).alias(f"{row}\\{column}"), *[c for c in df.columns if c != row]), path)


def markdown_table(df: DataFrame, max_rows: int = 1000, digits: int = 4, formats: dict[str, str] | None = None) -> str:
    """A report-sized table as Markdown: numbers to some digits, or as formats say of a column (.3e, .12g, .1%), missing ones empty, bars
    escaped; an error beyond max_rows rows."""

    def cell(name: str, x: object) -> str:
        if x is None or x != x:
            return ""
        form = (formats or {}).get(name) or (f".{digits}f" if isinstance(x, float) else None)
        return (format(x, form) if form else str(x)).strip().replace("|", "\\|").replace("\n", " ")

    rows = [[cell(n, x) for n, x in zip(df.columns, r)] for r in _report(df, max_rows)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def write_report(spark: SparkSession, path: str, title: str, sections: list[tuple[str, str | DataFrame]]) -> None:
    """A Markdown file: a title, then sections of a heading and a text or a table."""
    parts = [f"# {title}"]
    for heading, body in sections:
        parts.append(f"## {heading}\n\n{body if isinstance(body, str) else markdown_table(body)}")
    _put(spark, path, ("\n\n".join(parts) + "\n").encode())


def remove_outputs(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Deletes the files of a name below a folder, which earlier runs left; their paths."""
    try:
        paths = find_files(spark, folder, pattern)
    except FileNotFoundError:
        return []
    for path in paths:
        discard(spark, path)
    return [posixpath.basename(p) for p in paths]


def write_verified(tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None]) -> None:
    """Writes tables as Parquet at their paths, all or none: each is written beside its path, check looks at what was
    written, by path, and raises what is wrong with it; only then do the new tables take the places of the old.

    If check, or a write, fails, nothing changes and what was written goes. A reader may meet the moment between two renames, when a path is away."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    staged = {path: f"{path.rstrip('/')}._new-{mark}" for path in tables}
    try:
        for path, df in tables.items():
            df.write.parquet(staged[path])
        check({path: spark.read.schema(df.schema).parquet(staged[path]) for path, df in tables.items()})
        moved: list[tuple[str, str]] = []
        try:
            for path, new in staged.items():
                fs, old = hadoop(path).getFileSystem(conf), f"{path.rstrip('/')}._old-{mark}"
                for a, b in ((path, old), (new, path)):
                    if a == path and not fs.exists(hadoop(path)):
                        continue
                    if not fs.rename(hadoop(a), hadoop(b)):
                        raise OSError(f"{a} could not be renamed to {b}")
                    moved.append((a, b))
        except Exception:
            for a, b in reversed(moved):
                hadoop(a).getFileSystem(conf).rename(hadoop(b), hadoop(a))
            raise
        for path in tables:
            discard(spark, f"{path.rstrip('/')}._old-{mark}")
    finally:
        for new in staged.values():
            discard(spark, new)
