"""Near copies by SimHash fingerprints, and by the similarity of shingle sets: candidates by min-hash bands, each pair confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sparkloom.llm.common import components, free_names, join_hot, small, stored
from sparkloom.llm.simhash import SEED, digests, fingerprint, links

#: Two sets of similarity 0.8 share no band of six in 32 with a chance of (1 - 0.8 ** 6) ** 32 = 0.00006; sets of similarity
#: 0.35 share one with a chance of 0.06.
BANDS, DEPTH = 32, 6
_RNG = np.random.default_rng(SEED)
_ADD = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64)
_MUL = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, DEPTH), np.uint64) | np.uint64(1)
_CHUNK = 1 << 11
#: So many rows of a batch have their shingles in memory at once.
_ROWS = 500


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the runs of width words, sorted; a shorter text is one run."""
    found = [*digests(text, width)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def bands(items: np.ndarray) -> np.ndarray:
    """A number for each band of min-hashes; none for an empty set."""
    if not len(items):
        return np.empty(0, np.int64)
    least = np.full(BANDS * DEPTH, ~np.uint64(0))
    for i in range(0, len(items), _CHUNK):
        least = np.minimum(least, ((items[i : i + _CHUNK] ^ _ADD) * _MUL).min(axis=1))
    return (least.reshape(BANDS, DEPTH) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def _key(items: np.ndarray) -> int:
    """Names a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(items.tobytes(), SEED) - (1 << 63) if len(items) else 0


def _similar(pairs: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets (key, items) share min_percent of all their shingles or more."""
    pairs = stored(pairs, "near-copy-pairs")
    for end in ("a", "b"):
        counted = stored(pairs.groupBy(F.col(end).alias("key")).agg(F.count("*").alias("n")).join(sets, "key"), "near-copy-ends")
        counted = counted.select(F.col("key").alias(end), F.col("items").alias(f"items_{end}"), F.col("n").alias(f"n_{end}"))
        pairs = join_hot(pairs, counted, end, f"n_{end}")
    common = F.size(F.array_intersect("items_a", "items_b"))
    alike = 100 * common >= min_percent * (F.size("items_a") + F.size("items_b") - common)
    return stored(pairs.where(alike).select("a", "b"), "near-copy-links")


def _close(members: DataFrame, sets: DataFrame, min_percent: int) -> tuple[DataFrame, DataFrame]:
    """(sure, possible): pairs (a, b) of members (head, key, root) of one head with different roots. All sure ones are similar, and a pair that is
    similar is possible, or sure pairs and roots join its ends.

    A set is told by its difference D from what most sets of its head hold. Sets x and y are similar if and only if they differ in at
    most c (|x| + |y|) shingles, c = (100 - min_percent) / (100 + min_percent). With w(x) = |D| - c |x| they surely are if w(x) + w(y) <= 0; each
    set of such a pair is then so paired with the set of least w. Else they must share (w(x) + w(y)) / 2 or more of
    their differences: so, of each difference sorted by how few sets have a shingle in it, one among the first
    |D| - (w(x) + least w) / 2 + 1. Texts that each differ from one text in a place of their own thus meet only neighbours."""
    less, more = 100 - min_percent, 100 + min_percent
    held = stored(members.join(sets, "key").select("head", "key", "root", "items"), "near-copy-held")
    n = held.groupBy("head").agg(F.count("*").alias("n"))
    usual = held.select("head", F.explode("items").alias("e")).groupBy("head", "e").agg(F.count("*").alias("n_e")).join(n, "head").where("2 * n_e > n")
    # At most twice the shingles of a set of the head's, on average.
    usual = n.join(usual.groupBy("head").agg(F.collect_list("e").alias("usual")), "head", "left").select("head", "n", F.coalesce("usual", F.array().cast("array<bigint>")).alias("usual"))
    told = join_hot(held, stored(usual, "near-copy-usual"), "head", "n")
    told = told.select("head", "key", "root", F.size("items").alias("size"), F.concat(F.array_except("items", "usual"), F.array_except("usual", "items")).alias("d"))
    told = stored(told.withColumn("w", more * F.size("d") - less * F.col("size")), "near-copy-differences")
    centre = stored(told.groupBy("head").agg(F.min(F.struct("w", "key", "root")).alias("c"), F.count("*").alias("n")), "near-copy-centres")
    told = join_hot(told, centre, "head", "n").withColumn("sum", F.col("w") + F.col("c.w"))
    sure = told.where("sum <= 0 and root <> c.root").select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b"))
    shared = F.greatest(F.ceil(F.col("sum") / (2 * more)), F.lit(1))
    spread = stored(told.select("head", "key", "root", (F.col("sum") <= 0).alias("sure"), (F.size("d") - shared + 1).alias("first"), F.explode("d").alias("e")), "near-copy-shingles-apart")
    few = stored(spread.groupBy("head", "e").agg(F.count("*").alias("n")), "near-copy-frequencies").withColumn("at", F.struct("head", "e"))
    counted = join_hot(spread.withColumn("at", F.struct("head", "e")).drop("head", "e"), few.select("at", "n"), "at", "n")
    order = Window.partitionBy("at.head", "key").orderBy("n", "at.e")
    early = counted.withColumn("place", F.row_number().over(order)).where("place <= first and n > 1")
    early = stored(early.select("at", "key", "root", "sure"), "near-copy-prefixes")
    other = early.select("at", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("sure").alias("sure_b"))
    possible = early.join(other, "at").where("key < b and root <> root_b and not (sure and sure_b)").select(F.col("key").alias("a"), "b")
    return sure.distinct(), possible.distinct()


def _links(members: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """(a, b): similar pairs of members (bucket, key, head) that join all whom similar pairs of a bucket's members join.

    First all of a bucket are held against its head. Those in one component need no other link, so only sets of heads
    whose sets lie in several components go on to _close(); a large group of copies of one text is not spread into pairs."""
    heads = members.select("head", "key").distinct()
    first = _similar(heads.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")), sets, min_percent)
    of = components(first, "near-copy-components").withColumnRenamed("node", "key")
    at = stored(heads.join(of, "key", "left").select("key", "head", F.coalesce("root", "key").alias("root")), "near-copy-members")
    open_ = at.groupBy("head").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("head")
    sure, possible = _close(at.join(open_, "head", "left_semi"), sets, min_percent)
    return first.unionByName(sure).unionByName(_similar(possible, sets, min_percent))


def _fingerprint_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): pairs of sets that join all whose texts in rows (fp, key) have equal or linked fingerprints: the least set of a fingerprint with each
    other one of its own, and with the least sets of the fingerprints that SimHash links to it. So copies are not spread into pairs, and
    the groups are found once, over these and all other links."""
    held = stored(rows.select("fp", "key").distinct(), "fingerprint-sets")
    heads = stored(held.groupBy("fp").agg(F.min("key").alias("a"), F.count("*").alias("n")), "fingerprint-heads")
    own = join_hot(held, heads.where("n > 1"), "fp", "n").where("key <> a").select("a", F.col("key").alias("b"))
    return own.unionByName(links(heads, max_bits=max_bits, name="a"))


def one_of_each(docs: DataFrame, *, width: int = 5, min_percent: int = 80, max_bits: int | None = None) -> DataFrame:
    """The rows of docs that stay when of each group of near copies one row does: that with the smallest doc_id.

    Two texts are near copies if min_percent of all the distinct runs of width words (lower-cased, split at ASCII
    white space) that either holds are in both; a group is what such pairs join. Texts with equal sets, and those
    without words, are one class. With max_bits, texts whose SimHash fingerprints differ in so many bits or fewer, which
    simhash.links finds, are near copies too. Of repeated rows and of rows without a doc_id, which come last, any one stays.
    All columns pass through unchanged."""
    # Spark's mapInArrow takes no dots in names.
    names, docs = docs.columns, docs.toDF(*[c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)])
    name, kinds, row, fp = free_names(docs.columns, "_copy_key", "_copy_bands", "_copy_row", "_copy_fp")
    schema = StructType([*docs.schema, StructField(name, LongType()), StructField(kinds, ArrayType(LongType())), StructField(fp, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t.as_py(), width) for t in batch.column("text")]
            prints = [None if max_bits is None else fingerprint(t.as_py()) for t in batch.column("text")]
            made = [pa.array([_key(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, name, kinds, fp])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = pa.array([shingles(t.as_py(), width).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), sets], ["key", "items"])

    rows = stored(docs.mapInArrow(add, schema).withColumn(row, F.monotonically_increasing_id()), "rows-with-bands")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    classes = stored(rows.groupBy(F.col(name).alias("key")).agg(F.min(order).alias("first")), "near-copy-classes")
    shown = classes.select("key", F.col("first.row").alias("row"))
    parts = rows.select(F.col(row).alias("row"), F.explode(kinds).alias("bucket")).join(shown, "row").select("bucket", "key")
    parts = stored(parts, "near-copy-bands")
    shared = stored(parts.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("head")).where("n > 1"), "near-copy-buckets")
    members = stored(join_hot(parts, shared, "bucket", "n").select("bucket", "key", "head"), "near-copy-candidates")
    wanted = stored(members.select("key").distinct().join(shown, "key"), "near-copy-shown")
    texts = rows.select(F.col(row).alias("row"), "text").join(small(wanted, 200_000), "row").select("key", "text")
    sets = stored(texts.mapInArrow(items, "key long, items array<long>"), "near-copy-shingles")
    joined = _links(members, sets, min_percent)
    if max_bits is not None:
        joined = joined.unionByName(_fingerprint_links(rows.select(F.col(fp).alias("fp"), F.col(name).alias("key")), max_bits))
    of = components(joined, "near-copy-groups").withColumnRenamed("node", "key")
    keep = classes.join(of, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first")["row"].alias(row))
    return rows.join(keep.select(row), row, "left_semi").select(*docs.columns).toDF(*names)
