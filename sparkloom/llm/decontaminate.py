"""Benchmark decontamination by winnowing: shared fingerprints propose, whole windows confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ALNUM_WORD, hashed_runs, let, lower_ascii, runs, small, stored, words


def _word_hashes(text: Column) -> Column:
    return F.transform(words(lower_ascii(F.coalesce(text, F.lit(""))), ALNUM_WORD), lambda w: F.xxhash64(w))


def _fingerprints(hashes: Column, k: int, span: int) -> Column:
    """The winnowed fingerprints of an item or document: array of (len, at, fp, wins).

    Each window of span words has the least hash of its k-grams as fingerprint; neighbours that share
    it make one entry, with the hashes of all their windows from position at on. So every shared span
    of span words or more has a fingerprint in common, however it is placed."""

    def select(m: Column, wins: Column) -> Column:
        n = F.size(m)
        starts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, j: F.struct(
                    F.lit(span).alias("len"),
                    at.alias("at"),
                    F.get(m, at).alias("fp"),
                    F.slice(wins, at + 1, F.coalesce(F.get(s, j + 1), n) - at).alias("wins"),
                ),
            ),
        )

    def of(g: Column) -> Column:
        count = F.greatest(F.size(g) - (span - k), F.lit(0))
        whole = F.zip_with(F.slice(g, 1, count), F.slice(g, span - k + 1, count), lambda a, b: F.xxhash64(a, b))
        least = runs(g, span - k + 1, lambda a, b: F.least(a, b))
        return let(F.struct(least.alias("m"), whole.alias("w")), lambda x: select(x["m"], x["w"]))

    return let(hashed_runs(hashes, k), of)


def _short(hashes: Column, width: int) -> Column:
    """Every run of width words as an entry of its own: what finds items of fewer words than a span."""
    return F.transform(
        hashed_runs(hashes, width),
        lambda g, at: F.struct(F.lit(width).alias("len"), at.alias("at"), g.alias("fp"), F.array(g).alias("wins")),
    )


def _union_length(spans: Column) -> Column:
    """Words that the spans (at, len) cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(end - F.greatest(state["end"], s["at"]), F.lit(0))).alias("n"))

    return F.aggregate(F.sort_array(spans), start, add, lambda state: state["n"])


def contamination(docs: DataFrame, items: DataFrame, *, span: int = 10, k: int = 5, max_broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated), a row for each row of docs.

    docs has doc_id and text, items has item_id and text; other columns are ignored. A window is span
    consecutive words of an item, or the whole item if it has fewer; a document's word is hit if it lies
    in an occurrence of a window. items lists the ids, as strings in order, of items with a window in
    the document. Null and empty texts have no words and are never hit; items without an id count as
    hits but are not listed; repeated items are listed once. Hashes of 64 bits stand for words, and a
    window must agree in its fingerprint and in its own hash. Needs span / 2 <= k <= span.
    """
    if not k <= span <= 2 * k:
        raise ValueError("k-grams must cover a span: span / 2 <= k <= span")
    hashed = items.select(F.col("item_id").cast("string").alias("item_id"), _word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    hashed = stored(hashed, "benchmark-words")
    lengths = sorted(r[0] for r in hashed.select(F.size("h").alias("n")).where(F.col("n") < span).distinct().collect())  # below span
    entries = F.when(F.size("h") >= span, _fingerprints(F.col("h"), k, span))
    for n in lengths:
        entries = entries.when(F.size("h") == n, _short(F.col("h"), n))
    windows = hashed.select("item_id", F.explode(entries).alias("e")).select("item_id", "e.len", "e.fp", F.explode("e.wins").alias("win"))
    windows = stored(windows.distinct(), "benchmark-windows")
    # Windows found in the same items share a set: it is named by its size and two sums over its ids.
    one = F.struct(F.count("item_id").alias("n"), F.bit_xor(F.xxhash64("item_id")).alias("x"), F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("y"))
    by_window = stored(windows.groupBy("len", "win").agg(one.alias("set")), "benchmark-sets")
    samples = by_window.groupBy("set").agg(F.min(F.struct("len", "win")).alias("s")).select("set", "s.len", "s.win")
    members = stored(samples.join(windows, ["len", "win"]).where("item_id is not null").select("set", "item_id").distinct(), "benchmark-set-members")
    prints = stored(windows.select("len", "fp").distinct().withColumn("known", F.lit(True)), "benchmark-fingerprints")

    def entries_of(h: Column) -> Column:
        mark = F.struct(F.lit(0).alias("len"), F.lit(0).alias("at"), F.col("row").alias("fp"), F.array().cast("array<bigint>").alias("wins"))
        found = [F.array(mark), _fingerprints(h, k, span), *(_short(h, n) for n in lengths)]
        return F.struct(F.size(h).cast("long").alias("n_words"), F.concat(*found).alias("all"))

    # Each row's first entry only marks it, under a key of its own, so that rows without hits stay.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", let(_word_hashes(F.col("text")), entries_of).alias("x"))
    rows = rows.select("row", "doc_id", "x.n_words", F.explode("x.all").alias("e")).select("row", "doc_id", "n_words", "e.*")
    hits = rows.join(small(prints, max_broadcast_rows), ["len", "fp"], "left").where("len = 0 or known")
    hits = hits.select("row", "doc_id", "n_words", "len", "at", F.posexplode_outer("wins").alias("i", "win"))
    hits = hits.join(small(by_window, max_broadcast_rows), ["len", "win"], "left").where("len = 0 or set is not null")
    spans = F.collect_set(F.when(F.col("len") > 0, F.struct((F.col("at") + F.col("i")).alias("at"), "len")))
    per_row = hits.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), _union_length(spans).cast("long").alias("n_hit"), F.collect_set("set").alias("sets"))
    per_row = stored(per_row, "document-hits")
    listed = per_row.select("row", F.explode("sets").alias("set")).join(small(members, max_broadcast_rows), "set")
    listed = listed.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = per_row.join(listed, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
