"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import small, stored

UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")
_SHIFT = 21  # bits of a code point
_CHUNK = 1 << 20


def gram_counts(text: str | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of 1 to longest characters of a text's lower-cased letters, as numbers in
    order, and their counts. Whatever is no letter parts words, marked by one space each side; grams of
    spaces only do not count."""
    line = " " + _NOT_LETTERS.sub(" ", text or "").lower().strip() + " "
    if line == "  ":
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(chars), _CHUNK):
        piece = chars[at : at + _CHUNK + longest - 1]
        code, found = np.zeros(len(piece), np.int64), []
        for n in range(longest):
            code = (code[: len(piece) - n] << _SHIFT) | piece[n:]
            found.append(code[:_CHUNK])
        parts.append(np.unique(np.concatenate(found), return_counts=True))
    if len(parts) > 1:
        grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
    else:
        grams, counts = parts[0]
    real = grams != 32
    return grams[real], counts[real]


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent grams in order; of equals, the smaller number first."""
    if len(grams) > size:
        least = np.partition(counts, -size)[-size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


_SEED = 11
_SPARE = 20  # drawn beyond what was asked for, so that no language is left out by chance


def learn_profiles(docs: DataFrame, *, size: int = 300, longest: int = 3, max_documents: int = 20_000) -> dict[str, list[int]]:
    """The size most frequent n-grams, in order, of each language of docs (text, lang).

    About max_documents documents of a language teach its profile, drawn row by row with a seed, by a share that its
    number of documents sets; all of them if there are fewer. Rows without a language or letter teach nothing. The result holds size numbers a language."""
    teach = docs.where("lang is not null and text is not null").select("lang", "text")
    share = teach.groupBy("lang").agg((F.lit(float(max_documents + _SPARE)) / F.count("*")).alias("share"))
    share = stored(share, "language-shares")
    if share.isEmpty():
        return {}
    sample = teach.withColumn("draw", F.rand(_SEED)).join(small(share, 10_000), "lang").where(F.col("draw") < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([g for g, _ in sums[lang]]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([c for _, c in sums[lang]])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums.setdefault(lang, []).append(gram_counts(text, longest))
                if len(sums[lang]) == 256:
                    sums[lang] = [merged(lang)]
        for lang in sums:
            grams, counts = merged(lang)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams, "n": counts})

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return {r["lang"]: list(r["grams"]) for r in _top(counts, size).collect()}


def _top(counts: DataFrame, size: int) -> DataFrame:
    """The size most frequent grams of each language, first within buckets of the grams and then of those."""
    def cut(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)

    best = cut(cut(counts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(64))), "lang", "bucket").drop("rank"), "lang")
    return best.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams"))


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], *, longest: int = 3) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of docs (doc_id, text); other columns are ignored.

    A document's most frequent n-grams, as many as a profile has, are compared with each profile: a gram
    costs the difference of its two ranks, or the profile's size if it is missing. The least sum wins,
    of equal ones the first language in order; score is 1 less this sum's share of the largest
    possible. A null text or one without letters is 'und' with score 0, and so is every text if no
    language was learned.
    """
    names = sorted(profiles)
    sizes = max((len(p) for p in profiles.values()), default=0)
    tables = []
    for name in names:
        p = np.array(profiles[name], np.int64)
        order = np.argsort(p)
        tables.append((p[order], order))

    def judge(text: str | None) -> tuple[str, float]:
        own = top_grams(*gram_counts(text, longest), sizes)
        if not len(own) or not names:
            return UNKNOWN, 0.0
        ranks, costs = np.arange(len(own)), []
        for p, rank in tables:
            at = np.minimum(np.searchsorted(p, own), len(p) - 1)
            costs.append(int(np.where(p[at] == own, np.abs(rank[at] - ranks), sizes).sum()))
        best = int(np.argmin(costs))
        return names[best], 1 - costs[best] / (sizes * len(own))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
