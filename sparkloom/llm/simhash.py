"""SimHash near-duplicates: fingerprints, and links by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkloom.llm.common import components, free_names, join_hot, small, stored

SEED = 42
_CHUNK = 1 << 16


def digests(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of the runs of width words, in parts; a shorter text is one run, one without words has none."""
    found = (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    if not found:
        return
    width = min(width, len(found))
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = (ends - [len(w) for w in found])[: len(found) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _CHUNK):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint as a signed number; 0 without words."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in digests(text, width):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row for each row of docs. A null text has no words, so fingerprint 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(width: int, radius: int) -> Column:
    """All values of width bits with radius bits set or fewer: what a value is combined with for its Hamming ball."""
    found = [sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(width), r)]
    return F.lit(found).cast("array<bigint>")


def _bits(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, *, max_bits: int = 3, segments: int = 2, crowded: int = 500, max_broadcast_rows: int = 200_000, name: str | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints fp that differ in max_bits bits or fewer, some of them twice. With name, a
    and b are what this column of prints has for the two, in the order of the fingerprints.

    If the segments of a pair differ in max_bits bits in all, one of them differs in max_bits // segments
    at most. So each fingerprint asks, for every segment, for all values in that Hamming ball; a table
    of fingerprints by segment answers, and the complete distance is verified in the join. A segment of
    32 bits holds one fingerprint in 2**32 by chance, so most lists are short at any size. A value that more than crowded
    fingerprints have in a segment is not one list: what asks for it must also agree, by the same rule, in a half of
    one other segment. At most 43,744 fingerprints lie within 3 bits of one, so the links grow with the
    fingerprints, not with the square of a group.
    """
    width, radius = 64 // segments, max_bits // segments
    parts = [F.struct(F.lit(s).alias("s"), _bits(F.col("fp"), s * width, width).alias("v")) for s in range(segments)]
    named = [] if name is None else [name]
    by_part = prints.select("fp", *named, F.explode(F.array(*parts)).alias("p")).select("fp", *named, "p.s", "p.v")
    named_a, named_b = ([F.col(c).alias(f"name_{end}") for c in named] for end in "ab")
    ends = [F.col(f"name_{end}" if named else end).alias(end) for end in "ab"]
    full = stored(by_part.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("s", "v"), "crowded-segments")
    full = small(full, max_broadcast_rows)
    asked = by_part.select(F.col("fp").alias("a"), *named_a, "s", F.explode(F.transform(_masks(width, radius), lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
    table = by_part.select(F.col("fp").alias("b"), *named_b, "s", "v")
    near = (F.col("a") < F.col("b")) & (_hamming(F.col("a"), F.col("b")) <= max_bits)
    light = asked.join(full, ["s", "v"], "left_anti").join(table.join(full, ["s", "v"], "left_anti").hint("shuffle_hash"), ["s", "v"]).where(near)
    # The segment after s, in two halves: a pair that agrees in s differs there in max_bits bits at most, so one half does in half of them.
    half = width // 2

    def halves(fp: str) -> Column:
        other = F.when(F.lit(False), F.lit(0).cast("long"))
        for s in range(segments):
            other = other.when(F.col("s") == s, _bits(F.col(fp), (s + 1) % segments * width, width))
        return F.array(*[F.struct(F.lit(i).alias("i"), _bits(other, i * half, half).alias("w")) for i in range(2)])

    held_a, held_b = (["name_a"], ["name_b"]) if named else ([], [])
    asks = asked.join(full, ["s", "v"], "left_semi").select("a", *held_a, "s", "v", F.explode(halves("a")).alias("h"))
    asks = asks.select("a", *held_a, "s", "v", "h.i", F.explode(F.transform(_masks(half, max_bits // 2), lambda m: F.col("h.w").bitwiseXOR(m))).alias("w"))
    answers = table.join(full, ["s", "v"], "left_semi").select("b", *held_b, "s", "v", F.explode(halves("b")).alias("h")).select("b", *held_b, "s", "v", "h.*")
    return light.select(*ends).unionByName(asks.join(answers, ["s", "v", "i", "w"]).where(near).select(*ends))


def classes(prints: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """(fp, n, root, component_id, n_links): each distinct fingerprint of prints (fp, doc_id) with its number of rows, its
    group, named by root, the smallest doc_id of the group and the number of other fingerprints that link to its own."""
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-classes")
    found = stored(links(least.select("fp"), max_bits=max_bits, segments=segments).distinct(), "fingerprint-links")
    n_links = found.select("a").union(found.select("b")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_links"))
    linked = least.join(n_links, "fp").join(components(found, "fingerprint-components").withColumnRenamed("node", "fp"), "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(of_root, "root").select("fp", "root", "component_id", "n_links")
    out = least.join(linked, "fp", "left").select(
        "fp",
        "n",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "least").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    return stored(out, "fingerprint-groups")


def near_duplicates(docs: DataFrame, *, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id, n_links), a row for each row of docs.

    component_id is the smallest doc_id that links reach from a document, itself included; n_links counts
    the other fingerprints that its own links to. Documents with equal fingerprints, those without words
    among them, form one class; only classes are linked, so groups of copies are not spread into pairs.
    Rows with equal ids get equal answers if their texts do. A null doc_id is never the smallest; a
    group that has no other has a null component_id. Other columns of docs are ignored.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    by_print = classes(prints, max_bits, segments)
    return join_hot(prints, by_print, "fp", "n").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def one_of_each(docs: DataFrame, *, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """The rows of docs that stay when of each group of near-duplicates one row does: that with the smallest doc_id.

    Of repeated rows and of rows without a doc_id, which come last, any one stays. All columns pass through unchanged."""
    fp, row = free_names(docs.columns, "_fp", "_row")
    schema = StructType([*docs.schema, StructField(fp, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], [*batch.schema.names, fp])

    rows = docs.mapInArrow(add, schema)
    rows = stored(rows.withColumn(row, F.monotonically_increasing_id()), "rows-with-fingerprints")
    by_class = classes(rows.select(F.col(fp).alias("fp"), "doc_id"), max_bits, segments)
    roots = join_hot(rows.select(F.col(fp).alias("fp"), F.col(row).alias("row"), "doc_id"), by_class.select("fp", "n", "root"), "fp", "n")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keep = roots.groupBy("root").agg(F.min(order)["row"].alias(row)).select(row)
    return rows.join(keep, row, "left_semi").drop(fp, row)
