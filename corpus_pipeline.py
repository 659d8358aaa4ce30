"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's documents.

Columns other than those of documents are dropped. Rows are judged by what they hold: any column may be null, ids may repeat,
and an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, discard, folder_for, scratch, stored, words
from sparkloom.llm.decontaminate import contamination
from sparkloom.llm.line_templates import dedup_lines
from sparkloom.llm.mixing import mix
from sparkloom.llm.near_copies import one_of_each
from sparkloom.llm.quality_rules import quality_verdicts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail; repeated rows fare alike."""
    return quality_verdicts(docs).where("kept").select(*COLUMNS)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template another document holds; n_chars counts what is left of a text
    that lost any. No row goes: rows without an id or text stay as they are, and rows of one id are parts of one document."""
    out = dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose SimHash fingerprints differ in 3 bits or fewer, found by multi-index hashing as in
    op9, and beyond the reach of fingerprints those that share four fifths of their five-word shingles.

    It is the row with the smallest id, rows without one last; all texts without words are one group."""
    return one_of_each(docs.select(*COLUMNS), max_bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window. Texts are judged, whatever ids they have; null and empty ones stay."""
    docs = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs.select(F.col("_key").alias("doc_id"), "text"), items).where("contaminated")
    bad = stored(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.join(bad, "_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, numbered by copy from 1. Null is a source of its own."""
    docs = docs.select(*COLUMNS).withColumn("_size", F.size(words(F.col("text"), WORD)).cast("long"))
    taken = mix(docs.select("doc_id", "text", "source"), each=False).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_n"), "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_n"))
    return docs.join(taken, same).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]
#: SQL cannot express the seeded fingerprints of the near-duplicate stage; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again. What a stage stores on its way goes
    when its result is written, and that result when the next one is; the last stage's input stays, for the rows that this returns."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = folder_for(spark, name)
        with scratch(spark, f"{name}-scratch"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
