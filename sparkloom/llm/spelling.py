"""Spelling variants: words one edit apart, found through groups of equal wildcards and through deletions, never as pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import lower_ascii, stored

#: A letter of a word, once A-Z is lower-cased.
LETTER = r"[a-zÀ-ÿ]"
#: Longer words are keyed by digests, since their keys as strings would take the square of their length.
_LONG = 64
#: The modulus and bases of the digests; two of them make 122 bits.
_PRIME, _BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def vocabulary(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of min_length letters or more with min_count occurrences or more in all rows of docs.

    A word is a run of letters, A-Z lower-cased. Where every divides the crc32 h of '<doc_id>:<run>', the run loses the
    letter at place h % length. A null text has no words; a null doc_id counts as an empty one; repeated rows count each."""
    runs = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(f"{LETTER}{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = found.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _digests(word: str) -> tuple[list[str], list[str], str]:
    """Keys of a word's wildcards, of its deletions and of itself, in time that is linear in its length."""
    length, wild, cut, whole = len(word), [""] * len(word), [""] * len(word), ""
    for base in _BASES:
        powers, ahead = [1], [0]
        for c in word:
            powers.append(powers[-1] * base % _PRIME)
            ahead.append((ahead[-1] * base + ord(c)) % _PRIME)
        total, after = ahead[-1], 0
        for i in range(length - 1, -1, -1):
            wild[i] += f"{(total - ord(word[i]) * powers[length - 1 - i]) % _PRIME:x}."
            cut[i] += f"{(ahead[i] * powers[length - 1 - i] + after) % _PRIME:x}."
            after = (after + ord(word[i]) * powers[length - 1 - i]) % _PRIME
        whole += f"{total:x}."
    return [f"{length}*{i}.{k}" for i, k in enumerate(wild)], [f"{length - 1}:{k}" for k in cut], f"{length}:{whole}"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            wild, cut, whole = _digests(word)
            cut = [k for i, k in enumerate(cut) if i == 0 or word[i] != word[i - 1]]
            for keys, kind in ((wild, "wild"), (cut, "cut"), ([whole], "whole")):
                for i in range(0, len(keys), 10_000):
                    part = keys[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([word] * len(part)), pa.array([n] * len(part), pa.int64()), pa.array([kind] * len(part)), pa.array(part)], ["word", "n", "kind", "key"])


def keys(words: DataFrame) -> DataFrame:
    """(word, n, kind, key) of words (word, n). Words of one length that differ in one letter share one key of kind wild;
    a word is one insertion from another if a key of kind cut of the longer is the key of kind whole of the shorter."""
    length = F.length("word")
    short = words.where(length <= _LONG).withColumn("i", F.explode(F.sequence(F.lit(1), length)))
    ahead, behind = F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i") + 1, length)
    wild = short.select("word", "n", F.lit("wild").alias("kind"), F.concat(ahead, F.lit("*"), behind).alias("key"))
    # Of a run of equal letters, deleting any gives the same word; the first stands for all.
    first = (F.col("i") == 1) | (F.substring("word", F.col("i"), F.lit(1)) != F.substring("word", F.col("i") - 1, F.lit(1)))
    cut = short.where(first).select("word", "n", F.lit("cut").alias("kind"), F.concat(ahead, behind).alias("key"))
    whole = words.where(length <= _LONG).select("word", "n", F.lit("whole").alias("kind"), F.col("word").alias("key"))
    # A word of one letter over the limit is keyed both ways, to meet what is one shorter and what is one longer.
    edge = words.where(length == _LONG + 1).withColumn("i", F.explode(F.sequence(F.lit(1), length))).where(first)
    edge = edge.select("word", "n", F.lit("cut").alias("kind"), F.concat(ahead, behind).alias("key"))
    long = words.where(length > _LONG).mapInArrow(_digested, "word string, n long, kind string, key string")
    return wild.unionByName(cut).unionByName(whole).unionByName(edge).unionByName(long)


def _rank(n: str, word: str) -> Column:
    """The least of these is the word of most occurrences, of equals the first in code-point order."""
    return F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each word of words (word, n) that has near words, how many, and the first of them as
    (-n, word). A group of wildcards has a word for each letter at most, 90; a word has at most 90 deletions to each of its
    places; so no window grows with the table."""
    keyed = keys(words)
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc("n"), "word")
    one = _rank("n", "word")
    wild = keyed.where("kind = 'wild'").select("key", "word", "n")
    wild = wild.select("word", (F.count("*").over(group) - 1).alias("n_near"), F.when(F.row_number().over(order) == 1, F.lead(one).over(order)).otherwise(F.first(one).over(order)).alias("best"))
    ends = keyed.where("kind <> 'wild'").select("key", "word", "n", (F.col("kind") == "whole").alias("whole"))
    longer, shorter = F.when(~F.col("whole"), one), F.when(F.col("whole"), one)
    ends = ends.select(
        "word",
        F.when(F.col("whole"), F.count(longer).over(group)).otherwise(F.count(shorter).over(group)).alias("n_near"),
        F.when(F.col("whole"), F.min(longer).over(group)).otherwise(F.min(shorter).over(group)).alias("best"),
    )
    both = wild.unionByName(ends).where("n_near > 0")
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), where root is the last form that a chain of forms reaches. Each step of a chain
    multiplies the occurrences, so chains are short; only those that have not ended are followed."""
    steps = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    open_, done = forms.select("word", F.col("form").alias("root")), None
    while True:
        went = stored(open_.join(steps, "root", "left"), "spelling-chains")
        ended = went.where("next is null").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        open_ = went.where("next is not null").select("word", F.col("next").alias("root"))
        if open_.isEmpty():
            return done


def spelling_groups(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of vocabulary(docs).

    Two words are near if one inserted, deleted or replaced letter turns one into the other. form is the near word of most
    occurrences (of equals the first in code-point order) if it has ratio times the word's or more; root follows forms to
    the last and is the word itself if it has none. Other columns of docs are ignored; no words give an empty table."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or chains of forms may not end")
    words = stored(vocabulary(docs, min_length=min_length, min_count=min_count, every=every), "spelling-words")
    found = words.join(near_words(words), "word", "left")
    strong = -F.col("best.n") >= ratio * F.col("n")
    out = stored(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")),
        "spelling-forms",
    )
    last = roots(out.where("form is not null").select("word", "form"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
