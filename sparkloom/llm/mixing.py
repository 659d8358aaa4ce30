"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import let, small, stored, words

SEED = 7
_RESOLUTION = 1 << 53


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(key, n_rows, source_size, target) for each source of sizes (key, size), in words.

    The sources share epochs times all words by weight; weights go round over the sources in order of
    key. A source stops at max_copies times its size, and the others share its excess by weight until
    none is above: that is the level at which limit / weight cuts off, found in one pass over the
    sources in order of this ratio. The table has a row for each source, and only it is ordered as a
    whole.
    """
    per_source = stored(sizes.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), "source-sizes")
    rank = F.row_number().over(Window.orderBy("key"))
    weight = F.element_at(F.lit(list(weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight.cast("double")).withColumn("limit", max_copies * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    everything, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = epochs * F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.select("*", (left / open_weight).alias("level"), F.row_number().over(by_ratio).alias("place"))
    cut = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    levels = levels.select("*", F.min(cut).over(everything)["level"].alias("at"))
    return levels.select("key", "n_rows", "source_size", F.least("limit", F.coalesce(F.col("at") * F.col("weight"), F.col("limit"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts).bitwiseAND(F.lit(_RESOLUTION - 1)) / F.lit(float(_RESOLUTION))


def _unit(item: Column, p: Column) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["same"].alias("same"), item["nth"].alias("nth"), p.cast("double").alias("p"))


def _pivot(state: Column, item: Column, names: tuple[str, ...]) -> Column:
    """Pairs the open unit of a state with the next: words pass from one to the other until one of them
    has a whole number of copies. Which way they pass is drawn so that each keeps its expectation; the
    sum of words stays the same. names are the fields that the draw hashes."""
    a, b = state["open"], item
    size_a, size_b = a["size"] * a["same"], b["size"] * b["same"]
    room_a, held_a, room_b, held_b = (1 - a["p"]) * size_a, a["p"] * size_a, (1 - b["p"]) * size_b, b["p"] * size_b

    def moved(flow: Column) -> Column:
        to_a, to_b = flow["to_a"], flow["to_b"]
        toward_a = flow["u"] * (to_a + to_b) < to_b
        clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        a_full, b_full = (_unit(a, F.lit(1.0)), _unit(b, F.lit(1.0)))
        a_none, b_none = (_unit(a, F.lit(0.0)), _unit(b, F.lit(0.0)))
        step = lambda done, still: F.struct(still.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))
        return F.when(
            toward_a,
            F.when(room_a <= held_b, step(a_full, _unit(b, clip(b["p"] - to_a / size_b)))).otherwise(step(b_none, _unit(a, clip(a["p"] + to_a / size_a)))),
        ).otherwise(F.when(held_a <= room_b, step(a_none, _unit(b, clip(b["p"] + to_b / size_b)))).otherwise(step(b_full, _unit(a, clip(a["p"] - to_b / size_a)))))

    flow = F.struct(F.least(room_a, held_b).alias("to_a"), F.least(held_a, room_b).alias("to_b"), _uniform(*[x[n] for x in (a, b) for n in names]).alias("u"))
    return let(flow, moved)


def _round_chunks(units: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(key, chunk, s): folds the units (key, chunk, unit) of each chunk; one stays open."""
    chunks = units.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("unit")).alias("all"))
    nothing = F.filter("all", lambda _: F.lit(False))
    start = F.struct(F.element_at("all", 1).alias("open"), nothing.alias("done"))
    return chunks.select("key", "chunk", F.aggregate(F.slice("all", 2, F.size("all") - 1), start, lambda s, x: _pivot(s, x, names)).alias("s"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, max_copies: int = 2, chunk: int = 128, max_sources: int = 100_000, each: bool = True) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of docs.

    size is the number of words of text. Every document of a source gets floor(r) copies, where r is
    target / source_size, and one more with chance r - floor(r). These chances are rounded together:
    within chunks of about chunk documents, then among the one unit that each chunk leaves open, and so
    on up; the last open unit of a source goes to the nearer side, so that the source's words differ from
    its target by half a document at most. Reruns agree, for the draws are hashes of the ids.

    Nulls are a source of their own, last in order. A text without words has size 0, takes 0 words and
    gets floor(r) copies. Rows equal in doc_id, source and size are numbered, each is a unit of its own,
    and which of them has more copies does not matter; without each they are one unit, and get the same number of
    copies. Other columns of docs are ignored.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    sizes = stored(docs.select("doc_id", key.alias("key"), F.size(words(F.col("text"))).cast("long").alias("size")), "document-sizes")
    targets = stored(source_targets(sizes, weights, epochs, max_copies), "source-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    shares = stored(targets.select("*", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("p"), F.ceil(F.col("n_rows") / chunk).alias("chunks")), "source-shares")
    of_source = small(shares, max_sources)
    same = sizes.groupBy("doc_id", "key", "size").agg(F.count("*").alias("same"))
    if each:
        same = same.select("doc_id", "key", "size", F.lit(1).cast("long").alias("same"), F.explode(F.sequence(F.lit(1).cast("long"), "same")).alias("nth"))
    else:
        same = same.withColumn("nth", F.lit(1).cast("long"))
    names = ("doc_id", "size", "nth") if each else ("doc_id", "size")
    units = same.join(of_source.select("key", "p", "chunks"), "key")
    fixed = (F.col("size") == 0) | (F.col("p") == 0)
    settled = [units.where(fixed).select("key", "doc_id", "size", "same", "nth", F.lit(0.0).alias("p"))]
    place = F.pmod(F.xxhash64(*names), F.col("chunks"))
    open_units = units.where(~fixed).select("key", place.alias("chunk"), F.struct("doc_id", "size", "same", "nth", "p").alias("unit"))
    chunks = shares.agg(F.coalesce(F.max("chunks"), F.lit(1))).first()[0]
    while True:
        rounded = stored(_round_chunks(open_units, names), "rounded-chunks")
        settled.append(rounded.select("key", F.explode("s.done").alias("unit")).select("key", "unit.*"))
        if chunks <= 1:
            break
        open_units = rounded.select("key", F.floor(F.col("chunk") / chunk).alias("chunk"), F.col("s.open").alias("unit"))
        chunks = -(-chunks // chunk)
    last = rounded.select("key", "s.open.*")
    settled.append(last.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    out = done.join(of_source.select("key", "source_size", "target", "base"), "key")
    out = out.select("*", (F.col("base") + F.col("p")).cast("long").alias("copies"), F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("_"))
    source = F.when(F.col("key") != "1", F.substring("key", 2, 2**31 - 1))
    return out.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
