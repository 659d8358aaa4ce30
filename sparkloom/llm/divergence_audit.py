"""Divergence of the sources of each language: pairs of sources by their term shares, and the terms that set a source apart."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import small, stored

#: A term of UTF-8 whose A-Z are lower-cased: letters of ASCII, and whatever lies beyond ASCII.
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_PIECE = 1 << 20
_COUNTS = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a part of it at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def _counted(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a task's rows, by group; what most entries hold is sent on."""
    tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tally.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                names = [pa.array([x] * len(part)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array([t.decode() for t in part]), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        tally.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = tally.setdefault((lang, source), (Counter(), Counter()))
            held: set[bytes] = set()
            for terms in _pieces(text.lower()):  # of bytes: lowers A-Z only
                n.update(terms)
                held.update(terms)
            docs.update(held)
        if sum(len(n) for n, _ in tally.values()) > most:
            yield from rows()
    yield from rows()


def term_vectors(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, total, counts): the terms that min_docs rows of a language or more hold, with their occurrences by source,
    an array of (source, n) in order of the sources. It has an entry for each source of the language at most."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = rows.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return terms.where(F.col("docs") >= min_docs).drop("docs")


def _share(n: Column, all_n: Column, v: Column) -> Column:
    """Billionths that n occurrences are of all_n, with two more for each of v terms; exact."""
    more, of = n.cast("decimal(19,0)") + 2, all_n.cast("decimal(19,0)") + 2 * v.cast("decimal(18,0)")
    return 1 + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * more, of)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's distinct vectors of what each adds to every pair of a block of sources with all sources."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("first").to_pylist()))
        shares, times, ends = batch.column("shares").flatten().to_numpy(), batch.column("times").to_numpy(), np.cumsum(batch.column("shares").value_lengths().to_numpy())
        size = batch.column("size").to_numpy()
        for key in dict.fromkeys(keys):
            rows = [i for i, k in enumerate(keys) if k == key]
            width = int(ends[rows[0]] - (ends[rows[0] - 1] if rows[0] else 0))
            p = np.stack([shares[ends[i] - width : ends[i]] for i in rows])
            acc = total.setdefault(key, np.zeros((min(int(size[rows[0]]), width - key[1]), width), np.int64))
            for a in range(len(acc)):
                own = p[:, key[1] + a : key[1] + a + 1]
                acc[a] += ((p - own) ** 2 // (p + own) * times[rows][:, None]).sum(axis=0)
    for (lang, first), acc in total.items():
        for a, values in enumerate(acc):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([first + a], pa.int32()), pa.array([values], pa.list_(pa.int64()))], ["lang", "a", "values"])


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top: int = 10, block: int = 64, max_broadcast_rows: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank) for each pair of lang and source in docs; null text, lang and source count as ''.

    Terms of a language are those of term_vectors. A group gives a term p billionths of its terms, two occurrences added to
    each. Part pair: item is each other source of the language, value the gap of p and the other's, summed over all terms.
    Part term: item is a term that the group holds with a larger share than the whole language; value is their gap; the
    first top of them. Ranks are by value, largest first, then by item. Repeated rows count each; no rows give no rows.

    Terms with the same counts by source add the same to each pair, so pairs are evaluated once for a distinct vector, times
    its terms; block sources at a time are held against all. A vector has an entry for each source of a language at most: as
    pairs of sources are the result, that is the square root of what is returned."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    terms = stored(term_vectors(docs, min_docs), "audit-terms")
    cells = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size", "lang_size", "v")]), "audit-groups")
    lists = groups.groupBy("lang").agg(F.max("v").alias("v"), F.sort_array(F.collect_list(F.struct("source", "size"))).alias("groups"))
    lists = small(stored(lists, "audit-sources"), max_broadcast_rows)

    vectors = stored(terms.groupBy("lang", "counts").agg(F.count("*").alias("times")), "audit-vectors")
    dense = vectors.join(lists, "lang").withColumn("by_source", F.map_from_entries("counts"))
    dense = dense.withColumn("shares", F.transform("groups", lambda g: _share(F.coalesce(F.col("by_source")[g["source"]], F.lit(0).cast("long")), g["size"], F.col("v"))))
    dense = dense.select("lang", "times", "shares", F.lit(block).alias("size"), F.explode(F.sequence(F.lit(0), F.size("groups") - 1, F.lit(block))).alias("first"))
    sums = dense.mapInArrow(_summed, "lang string, a int, values array<bigint>")
    sums = sums.select("lang", "a", F.posexplode("values").alias("b", "value")).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = lists.select("lang", F.transform("groups", lambda g: g["source"]).alias("sources"))
    pairs = groups.select("lang", "source").join(named, "lang").select("lang", "source", F.array_position("sources", F.col("source")).alias("a"), F.posexplode("sources").alias("b", "item")).where("a - 1 <> b")
    pairs = pairs.join(sums.withColumn("a", F.col("a") + 1), ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    found = cells.join(small(groups, max_broadcast_rows), ["lang", "source"])
    found = found.withColumn("p", _share(F.col("n"), F.col("size"), F.col("v"))).withColumn("q", _share(F.col("total"), F.col("lang_size"), F.col("v"))).where("p > q")
    found = found.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Spark takes the first of each task's rows before it gathers a group.
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).unionByName(first.withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
