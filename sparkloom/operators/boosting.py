"""Boosted trees of all folds grown together from histograms, and the contributions of features to their margins.

Rows are (id, y, vector, fold). Model f learns from the rows of every other fold. A level of a round's trees takes one
aggregation, whatever the number of models: tasks add up gradients by model, node, feature and bin, and Spark sums them. Of two
children only the one with less cover is summed; the other's sums are what is left of their parent's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.sums import array_sums
from sparkloom.sources.shared import stored

#: Gradients are summed as whole numbers, so that sums in any order agree.
_SCALE = float(1 << 24)
#: Rows that are stored and looked at together, at most; Spark hands over batches of 10,000.
_ROWS = 1 << 14
#: Two features are counted together if their bins make so many cells at most.
_CELLS = 4096


@dataclass(frozen=True)
class Options:
    """The declared sizes: 120 rounds of depth 2. l1 and l2 shrink a leaf; a leaf holds least_weight of second-order weight at least."""

    rounds: int = 120
    depth: int = 2
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 5.0
    least_weight: float = 1.0
    bins: int = 32
    seed: int = 42


@dataclass
class Trees:
    """Trees of models: feature (-1 at a leaf), bin (up to it a row goes left), value, cover and gain, each (model, round, node)
    in heap order; base: a model's margin before any tree; cuts: by feature the upper ends of its bins."""

    cuts: list[np.ndarray]
    base: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def margins(self, codes: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
        """(rows, models): what trees start to end of each model add up to; the base is not in it."""
        return self._margins(np.ascontiguousarray(codes.T), start, self.feature.shape[1] if end is None else end)

    def _margins(self, by_feature: np.ndarray, start: int, end: int) -> np.ndarray:
        out = np.zeros((len(self.base), by_feature.shape[1]))
        for m in range(len(out)):
            for r in range(start, end):
                out[m] += self._reached(by_feature, m, r, self.value[m, r])
        return out.T

    def _reached(self, by_feature: np.ndarray, m: int, r: int, what: np.ndarray, node: int = 0) -> np.ndarray:
        """By row, what has at the node that the row reaches in a tree; one number if all rows reach one node."""
        f = 2 * node + 1 < len(what) and int(self.feature[m, r, node])
        if f is False or f < 0:
            return what[node]
        left, right = (self._reached(by_feature, m, r, what, 2 * node + i) for i in (1, 2))
        return np.where(by_feature[f] <= int(self.bin[m, r, node]), left, right)

    def rounds(self, start: int, end: int) -> Trees:
        """The trees of rounds start to end alone, for tasks that need no others."""
        return Trees(self.cuts, self.base, *(x[:, start:end].copy() for x in (self.feature, self.bin, self.value, self.cover, self.gain)))


def _codes(vectors: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value; a missing one lies in the first."""
    out = np.zeros(vectors.shape, np.uint8)
    for j, c in enumerate(cuts):
        x = vectors[:, j]
        out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(c, x, "left"))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column as a matrix; nulls become NaN."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def bins_of(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """By feature the distinct approximate quantiles between bins parts of equal size, in one pass."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    value = lambda j: F.nullif(F.get("vector", F.lit(j)).cast("double"), F.lit(float("nan")))
    found = rows.agg(*[F.percentile_approx(value(j), shares, 10_000).alias(str(j)) for j in range(width)]).first()
    return [np.unique(np.array(found[j] if found[j] is not None else [], float)) for j in range(width)]


def binned(rows: DataFrame, cuts: list[np.ndarray], models: int, rows_a_task: int = 20_000) -> tuple[DataFrame, int]:
    """((draw, y, fold, codes, margins), parts), stored in as many parts as the rows need, up to 4,096 rows together as the bytes of
    arrays: draw is a number by which rows are drawn, codes has a byte for each feature, margins a zero for each model. A row
    without a label does not teach."""
    parts = max(1, ceil(rows.count() / rows_a_task))
    taught = rows.where("y is not null").select(F.xxhash64("id").alias("draw"), F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), F.col("vector").cast("array<double>").alias("vector"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _codes(_matrix(batch.column("vector")), cuts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("draw", "y", "fold")), pa.array([c.tobytes() for c in codes], pa.binary())], ["draw", "y", "fold", "codes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                own = batch.slice(i, _ROWS)
                block = [own.column("draw").to_numpy().tobytes(), own.column("y").to_numpy().tobytes(), own.column("fold").to_numpy().tobytes(), b"".join(own.column("codes").to_pylist()), bytes(8 * models * own.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in block], ["draw", "y", "fold", "codes", "margins"])

    coded = taught.mapInArrow(code, "draw long, y double, fold int, codes binary").repartition(parts)
    return stored(coded.mapInArrow(pack, "draw binary, y binary, fold binary, codes binary, margins binary"), "binned"), parts


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(draw, y, fold, codes, margins) of each stored block: codes (rows, features), margins (rows, models)."""
    for row in zip(*(batch.column(c) for c in ("draw", "y", "fold", "codes", "margins"))):
        draw, y, fold, codes, margins = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int64, float, np.int32, np.uint8, float)))
        yield draw, y, fold, codes.reshape(-1, width), margins.reshape(len(draw), -1)


def _drawn(draw: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Which rows a round's trees learn from: a hash of each row's number with the round's seed decides."""
    with np.errstate(over="ignore"):
        x = draw.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / (1 << 53) < share


def _joint(by_feature: np.ndarray, bins: int) -> np.ndarray:
    """(pairs of features, rows): a number for the bins of two neighbouring features together; the last of an odd number is alone."""
    out = by_feature[::2].astype(np.intp) * bins
    out[: by_feature.shape[0] // 2] += by_feature[1::2]
    return out


def _apart(sums: np.ndarray, bins: int) -> np.ndarray:
    """(..., features, slot, bin): the sums (..., pairs of features, slot, bins of both) of each feature by itself."""
    both = sums.reshape(*sums.shape[:-1], bins, bins)
    each = np.stack([both.sum(axis=-1), both.sum(axis=-2)], axis=-3)  # (..., pairs, which of two, slot, bin)
    return each.reshape(*sums.shape[:-3], 2 * sums.shape[-3], sums.shape[-2], bins)


def histograms(table: DataFrame, trees: Trees, done: int, r: int, slots: np.ndarray, held: list[int], options: Options, parts: int = 2) -> np.ndarray:
    """(model, slot, feature, bin, 2): sums of first and second derivatives of the log loss over the rows that a model learns from
    in round r. slots (models, nodes down to the level) tells each node's slot, -1 for nodes whose rows are not summed. margins
    of the table hold the first done rounds."""
    width, models, bins, count, near = len(trees.cuts), len(held), options.bins, int(slots.max()) + 1, trees.rounds(done, r + 1)
    pair = bins * bins <= _CELLS

    def add(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((models, 2, -(-width // 2) if pair else width, count * bins * (bins if pair else 1)))
        for draw, y, fold, codes, margins in _blocks(batch, width):
            by_feature = np.ascontiguousarray(codes.T)
            margins = margins + near.base + near._margins(by_feature, 0, r - done)
            places = _joint(by_feature, bins) if pair else by_feature.astype(np.intp)
            for m in range(models):
                slot = np.broadcast_to(near._reached(by_feature, m, r - done, slots[m]), len(codes))
                own = np.flatnonzero((fold != held[m]) & (slot >= 0) & _drawn(draw, options.rows, options.seed + 1000 * r + m))
                p = 1 / (1 + np.exp(-margins[own, m]))
                # Whole numbers below 2 ** 53 add up exactly as doubles.
                weights = [np.rint(d * _SCALE) for d in (p - y[own], p * (1 - p))]
                first = slot[own] * (total.shape[3] // count)
                for f, place in enumerate(places):
                    cells = place.take(own)
                    if count > 1:
                        cells += first
                    for i, weight in enumerate(weights):
                        total[m, i, f] += np.bincount(cells, weight, total.shape[3])
        total = total.reshape(models, 2, len(total[0, 0]), count, -1)
        return np.moveaxis(_apart(total, bins)[:, :, :width] if pair else total, 3, 2)

    found = array_sums(table, add, parts)
    out = found if found.size else np.zeros((models, 2, count, width, bins))
    return np.moveaxis(out.reshape(models, 2, count, width, bins), 1, -1) / _SCALE


def _weight(g: np.ndarray, h: np.ndarray, o: Options) -> np.ndarray:
    """The best value of a leaf."""
    return -np.sign(g) * np.maximum(np.abs(g) - o.l1, 0) / (h + o.l2)


def _score(g: np.ndarray, h: np.ndarray, o: Options) -> np.ndarray:
    return np.maximum(np.abs(g) - o.l1, 0) ** 2 / (h + o.l2)


def best_split(sums: np.ndarray, columns: np.ndarray, o: Options) -> tuple[int, int, float]:
    """(feature, bin, gain) of the largest gain in one node's sums (feature, bin, 2), of equals the first; (-1, 0, 0.0) if none is positive."""
    left = sums.cumsum(axis=1)
    total = left[:, -1:, :]
    right = total - left
    gain = _score(left[..., 0], left[..., 1], o) + _score(right[..., 0], right[..., 1], o) - _score(total[..., 0], total[..., 1], o)
    fit = (left[..., 1] >= o.least_weight) & (right[..., 1] >= o.least_weight) & columns[:, None]
    gain = np.where(fit, gain, -np.inf)
    at = int(np.argmax(gain))
    if not gain.flat[at] > 1e-9:
        return -1, 0, 0.0
    return at // gain.shape[1], at % gain.shape[1], float(gain.flat[at])


def fit(rows: DataFrame, held: list[int], options: Options = Options(), *, keep_every: int = 20) -> Trees:
    """A model for each of the folds held, fitted to the rows (id, y, vector, fold) of all others; -1 holds no fold.

    y is 0 or 1. All vectors have one width; a missing value goes left at each split. Every keep_every rounds the margins of
    all rows are stored anew, so that a round looks at few trees. Equal rows with equal ids are drawn together. Histograms
    of a level, models x nodes x features x bins, come to the driver; so does nothing else."""
    first = rows.select("vector").where("vector is not null").first()
    if first is None:
        raise ValueError("boosting needs rows")
    width, o, models = len(first["vector"]), options, len(held)
    cuts = bins_of(rows, width, o.bins)
    seen = {r["fold"]: (r["ones"], r["n"]) for r in rows.where("y is not null").groupBy("fold").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect()}
    base = np.zeros(models)
    for m, f in enumerate(held):
        ones, n = (sum(v[i] for k, v in seen.items() if k != f) for i in (0, 1))
        if not 0 < ones < n:
            raise ValueError(f"the rows beside fold {f} have one class only")
        base[m] = np.log(ones / (n - ones))
    size = (2 << o.depth) - 1
    shape = (models, o.rounds, size)
    trees = Trees(cuts, base, np.full(shape, -1), np.zeros(shape, int), np.zeros(shape), np.zeros(shape), np.zeros(shape))
    (table, parts), done = binned(rows, cuts, models), 0
    for r in range(o.rounds):
        if r - done >= keep_every:
            table, done = _advanced(table, trees, done, r), r
        draws = np.random.default_rng((o.seed, r))
        columns = np.zeros((models, width), bool)
        for m in range(models):
            columns[m, draws.choice(width, max(1, round(o.columns * width)), replace=False)] = True
        for level in range(o.depth):
            slots, smaller = np.full((models, (2 << level) - 1), -1), np.zeros((models, max(1, (1 << level) >> 1)), int)
            if not level:
                slots[:, 0] = 0
            for m, i in np.ndindex(smaller.shape) if level else ():
                parent = smaller.shape[1] - 1 + i
                if trees.feature[m, r, parent] >= 0:
                    smaller[m, i] = 2 * parent + 1 + int(trees.cover[m, r, 2 * parent + 2] < trees.cover[m, r, 2 * parent + 1])
                    slots[m, smaller[m, i]] = i
            if slots.max() < 0:
                break
            built = histograms(table, trees, done, r, slots, held, o, parts)
            if not level:
                sums = built
            else:
                whole, sums = sums, np.zeros((models, 1 << level, *built.shape[2:]))
                for m, i in zip(*np.nonzero(smaller)):
                    own = smaller[m, i] - (1 << level) + 1
                    sums[m, own], sums[m, own ^ 1] = built[m, i], whole[m, i] - built[m, i]
            for m in range(models):
                for i in range(1 << level):
                    node = (1 << level) - 1 + i
                    if level and trees.feature[m, r, (node - 1) // 2] < 0:
                        continue
                    g, h = sums[m, i, 0].sum(axis=0)
                    trees.cover[m, r, node], trees.value[m, r, node] = h, o.rate * _weight(g, h, o)
                    j, b, gain = best_split(sums[m, i], columns[m], o)
                    if j < 0:
                        continue
                    trees.feature[m, r, node], trees.bin[m, r, node], trees.gain[m, r, node] = j, b, gain
                    left = sums[m, i, j, : b + 1].sum(axis=0)
                    for child, (a, c) in ((2 * node + 1, left), (2 * node + 2, sums[m, i, j].sum(axis=0) - left)):
                        trees.cover[m, r, child], trees.value[m, r, child] = c, o.rate * _weight(a, c, o)
    return trees


def _advanced(table: DataFrame, trees: Trees, done: int, r: int) -> DataFrame:
    """The table with the margins of rounds done to r added."""
    width, near = len(trees.cuts), trees.rounds(done, r)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [(margins + near.margins(codes)).tobytes() for *_, codes, margins in _blocks(batch, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.binary())], batch.schema.names)

    return stored(table.mapInArrow(add, table.schema), "boosted-margins")


def scores(rows: DataFrame, trees: Trees, held: list[int]) -> DataFrame:
    """(id, y, fold, margin, score) of rows: each by the model that holds its fold; rows of other folds are left out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                all_ = trees.base + trees.margins(_codes(_matrix(batch.column("vector")), trees.cuts))
                of = [held.index(f) for f in batch.column("fold").to_pylist()]
                margin = all_[np.arange(len(of)), of]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "y", "fold")), pa.array(margin), pa.array(1 / (1 + np.exp(-margin)))], ["id", "y", "fold", "margin", "score"])

    own = rows.where(F.col("fold").isin(held)).select("id", F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), F.col("vector").cast("array<double>").alias("vector"))
    return own.mapInArrow(score, f"id {own.schema['id'].dataType.simpleString()}, y int, fold int, margin double, score double")


def contributions(trees: Trees, m: int, codes: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of a model's margin by the path-dependent rule, where a feature left out of a set takes both
    ways at its splits, weighted by the covers of what lies there. A row's add up to its margin less expected(trees, m).

    A leaf is worth its value times, for each feature on its path, whether the row goes along (if the feature is in the
    set) or the share of cover that does (if not); the weights of all sets of one size are one coefficient of a polynomial."""
    out = np.zeros((len(codes), len(trees.cuts)))
    for r in range(trees.feature.shape[1]):
        feature, cut, cover, value = (x[m, r] for x in (trees.feature, trees.bin, trees.cover, trees.value))
        stack: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            j = int(feature[node])
            if j >= 0:
                left = codes[:, j] <= cut[node]
                for child, along in ((2 * node + 1, left), (2 * node + 2, ~left)):
                    one, zero = path.get(j, (True, 1.0))
                    stack.append((child, path | {j: (along & one, zero * cover[child] / cover[node])}))
                continue
            n = len(path)
            for f, (one, zero) in path.items():
                sets = [np.ones(len(codes))]  # by size, the worth of the sets of the other features
                for g, (along, share) in path.items():
                    if g != f:
                        sets = [sum(x) for x in zip([s * share for s in sets] + [0.0], [0.0] + [s * along for s in sets])]
                worth = sum(factorial(k) * factorial(n - 1 - k) / factorial(n) * s for k, s in enumerate(sets))
                out[:, f] += value[node] * worth * (one - zero)
    return out


def expected(trees: Trees, m: int) -> float:
    """A model's margin with no feature known."""
    total = float(trees.base[m])
    for r in range(trees.feature.shape[1]):
        share = {0: 1.0}
        for node in range(trees.feature.shape[2]):
            if node in share:
                if trees.feature[m, r, node] < 0:
                    total += share[node] * trees.value[m, r, node]
                else:
                    for child in (2 * node + 1, 2 * node + 2):
                        share[child] = share[node] * trees.cover[m, r, child] / trees.cover[m, r, node]
    return total


def gain_importance(trees: Trees) -> np.ndarray:
    """(model, feature): mean gain of a feature's splits as a share of all features' means."""
    out = np.zeros((len(trees.base), len(trees.cuts)))
    for m in range(len(out)):
        used = trees.feature[m] >= 0
        count = np.bincount(trees.feature[m][used], minlength=out.shape[1])
        out[m] = np.bincount(trees.feature[m][used], trees.gain[m][used], out.shape[1]) / np.maximum(count, 1)
        out[m] /= max(out[m].sum(), 1e-300)
    return out


def shap_rows(rows: DataFrame, trees: Trees, held: list[int]) -> DataFrame:
    """(id, fold, base, margin, contributions) of rows, each by the model that holds its fold."""
    bases = [expected(trees, m) for m in range(len(held))]

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(_matrix(batch.column("vector")), trees.cuts) if batch.num_rows else np.zeros((0, len(trees.cuts)), np.uint8)
            fold = batch.column("fold").to_numpy()
            for m, f in enumerate(held):
                own = np.flatnonzero(fold == f)
                if len(own):
                    found, margin = contributions(trees, m, codes[own]), trees.base[m] + trees.margins(codes[own])[:, m]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(fold[own], pa.int32()), pa.array([bases[m]] * len(own)), pa.array(margin), pa.array(list(found), pa.list_(pa.float64()))], ["id", "fold", "base", "margin", "contributions"])

    own = rows.where(F.col("fold").isin(held)).select("id", F.col("fold").cast("int").alias("fold"), F.col("vector").cast("array<double>").alias("vector"))
    return own.mapInArrow(explain, f"id {own.schema['id'].dataType.simpleString()}, fold int, base double, margin double, contributions array<double>")


def _ranked(column: str) -> Column:
    """Rank from the largest on; equal values share the mean of their places."""
    order = Window.orderBy(F.desc(column))
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2


def importance(rows: DataFrame, held: list[int], options: Options = Options()) -> DataFrame:
    """(feature, gain_mean, gain_std, rank_gain, shap_mean, shap_std, rank_shap): over the models, gain importance and the mean size of
    a feature's contributions on the held-out rows, with their ranks from the largest on. A row for each feature."""
    trees = fit(rows, held, options)
    gains = gain_importance(trees)
    found = rows.sparkSession.createDataFrame([(m, j, float(gains[m, j])) for m in range(len(held)) for j in range(gains.shape[1])], "m int, feature int, gain double")
    gain = found.groupBy("feature").agg(F.avg("gain").alias("gain_mean"), F.stddev_samp("gain").alias("gain_std"))
    each = shap_rows(rows, trees, held).select("fold", F.posexplode("contributions").alias("feature", "c")).groupBy("fold", "feature").agg(F.avg(F.abs("c")).alias("size"))
    shap = each.groupBy("feature").agg(F.avg("size").alias("shap_mean"), F.stddev_samp("size").alias("shap_std"))
    out = gain.join(shap, "feature")
    return out.withColumn("rank_gain", _ranked("gain_mean")).withColumn("rank_shap", _ranked("shap_mean"))
