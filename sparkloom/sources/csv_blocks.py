"""CSV files read by many tasks although quoted fields may hold line breaks.

Spark cuts a file into blocks and a block into lines. Whether a block begins inside a quoted field depends on all blocks before it, but
each block can tell what either beginning leads to; a row a block is enough to settle where every one begins. Blocks are then
parsed where they lie, and a record that blocks cut is put together from its pieces."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.shared import few, stored

#: So many blocks and files may be told to every task.
MAX_BLOCKS = 1_000_000
_RECORDS = "file string, block long, at long, fields array<string>"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or at the start of a record, ends inside one. A quote opens a field only as
    its first character; within it two quotes are one; what follows the closing quote belongs to the field."""
    i = 0
    while True:
        if inside:
            j = line.find('"', i)
            if j < 0:
                return True
            if line[j + 1 : j + 2] == '"':
                i = j + 2
                continue
            inside, i = False, line.find(",", j + 1) + 1
            if not i:
                return False
        elif line[i : i + 1] == '"':
            inside, i = True, i + 1
        else:
            i = line.find(",", i) + 1
            if not i:
                return False


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, dict]]:
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            yield (row[0], row[1]), row[2], row[3:]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block's end is if it begins outside (zero) and inside (one) a quoted field."""
    at, state = None, [False, True]
    out: list[tuple[str, int, bool, bool]] = []
    for key, line, _ in _runs(batches):
        if key != at:
            if at:
                out.append((*at, *state))
            at, state = key, [False, True]
        if '"' in line:
            state = [ends_inside(line, s) for s in state]
    if at:
        out.append((*at, *state))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "block", "zero", "one"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, at, fields, piece, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(file), pa.array(block, pa.int64()), pa.array(at, pa.int64()), pa.array(fields, pa.list_(pa.string())), pa.array(piece, pa.string()), pa.array(text, pa.string())], ["file", "block", "at", "fields", "piece", "text"])


def _parsed(text: str) -> list[str]:
    """The fields of one record."""
    csv.field_size_limit(1 << 31)
    return next(csv.reader(io.StringIO(text, newline="")), [])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block; what comes before its first whole record and after its last is a piece: tail, head, or middle
    if the block lies within one field."""
    out: list[tuple] = []
    at, held, inside, first, n = None, [], False, "", 0

    def close() -> None:
        if held:
            out.append((*at, n, None, "middle" if first == "tail" else "head", "\n".join(held)))

    for key, line, (starts,) in _runs(batches):
        if key != at:
            close()
            at, held, inside, n = key, [], bool(starts), 0
            first = "tail" if inside else "record"
        held.append(line)
        inside = ends_inside(line, inside) if '"' in line else inside
        if not inside:
            text = "\n".join(held)
            if first == "tail":
                out.append((*at, n, None, "tail", text))
            elif text.strip("\r"):
                out.append((*at, n, _parsed(text.removesuffix("\r")), None, None))
            held, first, n = [], "record", n + 1
        if len(out) >= 5000:
            yield _batch(out)
            out = []
    close()
    if out:
        yield _batch(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [_parsed(t.removesuffix("\r")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fields, pa.list_(pa.string()))], ["file", "block", "at", "fields"])


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, at, fields): the records of CSV files (UTF-8, commas, double quotes); block and at give their order in a file.
    Empty lines are no records. A quoted field that its file never closes is an error."""
    lines = _lines(spark, paths)
    ends = stored(lines.mapInArrow(_ends, "file string, block long, zero boolean, one boolean"), "csv-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    # A block either sets the state, whatever it was, or keeps it, or turns it.
    ends = ends.withColumn("turns", F.sum(F.when(F.col("zero") & ~F.col("one"), 1).otherwise(0)).over(upto))
    setter = F.last(F.when(F.col("zero") == F.col("one"), F.struct("zero", "turns")), ignorenulls=True).over(before)
    ends = ends.withColumn("setter", setter).withColumn("so_far", F.coalesce(F.lag("turns").over(upto), F.lit(0)))
    turned = F.pmod(F.col("so_far") - F.coalesce("setter.turns", F.lit(0)), F.lit(2)) == 1
    starts = ends.select("file", "block", (F.coalesce("setter.zero", F.lit(False)) != turned).alias("starts"))
    starts = stored(starts, "csv-starts")
    if starts.count() > MAX_BLOCKS:
        raise ValueError(f"over {MAX_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    cut = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "starts")
    cut = stored(cut.mapInArrow(_cut, f"{_RECORDS}, piece string, text string"), "csv-records")
    pieces = cut.where("piece is not null")
    order = Window.partitionBy("file").orderBy("block", "at")
    pieces = pieces.withColumn("record", F.sum((F.col("piece") == "head").cast("int")).over(order))
    whole = pieces.groupBy("file", "record").agg(F.min_by("block", F.struct("block", "at")).alias("block"), F.min_by("at", F.struct("block", "at")).alias("at"), F.max_by("piece", F.struct("block", "at")).alias("last"), F.sort_array(F.collect_list(F.struct("block", "at", "text"))).alias("parts"))
    closed = F.when(F.col("last") == "tail", F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).otherwise(F.raise_error(F.concat(F.lit("a quoted field is not closed in "), "file")))
    stitched = whole.select("file", "block", "at", closed.alias("text")).mapInArrow(_joined, _RECORDS)
    return cut.where("piece is null").select("file", "block", "at", "fields").unionByName(stitched)


def table(spark: SparkSession, paths: str | list[str], schema: StructType, *, banner: bool = False) -> DataFrame:
    """The rows of CSV files by the names in each file's header, in whatever order it has them. The header is a file's first record, or
    with banner the first that holds all names; a file without one, a row with another number of fields, or a value
    of another type is an error. Empty values are null."""
    found = records(spark, paths)
    names = [f.name for f in schema]
    clean = F.transform("fields", lambda v: F.regexp_replace(v, "^﻿", ""))
    place = F.array(*[F.array_position(clean, n).cast("int") for n in names])
    fits = ~F.array_contains(place, 0)
    near = found.withColumn("place", place).withColumn("fits", fits)
    heads = near.where("fits") if banner else near
    heads = heads.groupBy("file").agg(F.min_by(F.struct("block", "at", "place", "fits", "fields"), F.struct("block", "at")).alias("head"))
    heads = stored(heads, "csv-heads")
    files = stored(found.select("file").distinct(), "csv-files")
    lost = files.join(heads.where("head.fits and size(head.fields) = size(array_distinct(head.fields))"), "file", "left_anti").limit(5).collect()
    if lost or heads.isEmpty():
        raise ValueError(f"no header {','.join(names)} in {', '.join(r[0] for r in lost) or paths}")
    body = found.join(few(heads, MAX_BLOCKS), "file").where(F.struct("block", "at") > F.struct("head.block", "head.at"))
    said = F.concat(F.lit("malformed row: "), F.array_join("fields", ","))
    body = body.where(F.when(F.size("fields") == F.size("head.fields"), True).otherwise(F.raise_error(said).cast("boolean")))
    out = []
    for i, f in enumerate(schema):
        raw = F.nullif(F.get("fields", F.get("head.place", F.lit(i)) - 1), F.lit(""))
        value = raw if f.dataType.typeName() == "string" else raw.try_cast(f.dataType)
        out.append(F.when(raw.isNotNull() & value.isNull(), F.raise_error(said).cast(f.dataType)).otherwise(value).alias(f.name))
    return body.select(*out)
