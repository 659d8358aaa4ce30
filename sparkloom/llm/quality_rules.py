"""Quality rules: basic counts, and the divergence of a document from its language's reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, covered, free_names, hashed_runs, let, small, stored, words

#: Character classes of the histogram, as regular-expression classes. Letters of ASCII's
#: lower case and rare control characters make up the class "lower".
CHAR_CLASSES = {
    "upper": r"A-Z",
    "digit": r"0-9",
    "point": r".,;:'\"?()\-",
    "symbol": r"!#*$%&|<>{}\[\]=+_~^@/\\`",
    "beyond_ascii": r"^\x00-\x7F",
}
CLASSES = (*CHAR_CLASSES, "space", "lower")
#: The classes that mark up a text rather than fill it.
MARKS = ("upper", "point", "symbol")
#: Frequent function words by language. Other languages learn theirs from their documents.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are with as he be by at this".split(),
    "fr": "de la le et les des en un une du est que dans qui pour au sur par pas plus".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: What parts words here: white space, control characters and marks that may stand around a word.
AROUND = r"""[\x00-\x20.,;:!?"'()\[\]{}*_]+"""
_LETTERS = "".join(map(chr, range(65, 65 + 26))) + "".join(map(chr, range(97, 97 + 26)))


def _terms(text: Column) -> Column:
    """The lower-cased words of a text without the marks around them."""
    return F.array_remove(F.split(F.lower(text), AROUND), "")


def _class_counts(text: Column, word_chars: Column) -> Column:
    """Code points of each of CLASSES."""
    n = [F.length(text) - F.length(F.regexp_replace(text, f"[{c}]+", "")) for c in CHAR_CLASSES.values()]
    n.append(F.length(text) - word_chars)
    return let(F.array(*n), lambda a: F.concat(a, F.array(F.length(text) - F.aggregate(a, F.lit(0), lambda t, x: t + x))))


def _common_counts(terms: Column, common: Column, of_any: list[str]) -> Column:
    """Occurrences of each of the common words, an array, and last all other words; null without common words. of_any
    holds the common words of all languages.

    Each occurrence becomes one letter of a string; what removing the letter takes off is its count."""
    some = F.filter(terms, lambda w: w.isin(of_any))
    letters = F.transform(some, lambda w: F.substring(F.lit(f" {_LETTERS}"), F.array_position(common, w).cast("int") + 1, F.lit(1)))

    def counts(h: Column) -> Column:
        each = F.transform(common, lambda _, i: F.length(h) - F.length(F.replace(h, F.substring(F.lit(_LETTERS), i + 1, F.lit(1)), F.lit(""))))
        return F.concat(each, F.array(F.size(terms) - F.length(F.replace(h, F.lit(" "), F.lit("")))))

    return F.when(F.size(common) > 0, let(F.array_join(letters, ""), counts))


def common_words(docs: DataFrame, *, size: int = 20, min_words: int = 10) -> DataFrame:
    """(lang, common): of each language the size words (52 at most) that most of its documents hold, in order; of equals the smaller
    word first. Documents of fewer than min_words words teach nothing; those without a language share ''. All documents
    count, each once however long it is or however often it repeats a word."""
    if not 1 <= size <= len(_LETTERS):
        raise ValueError(f"size must be 1 to {len(_LETTERS)}")
    terms = docs.where("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), _terms(F.col("text")).alias("terms"))
    held = terms.where(F.size("terms") >= min_words).select("lang", F.explode(F.array_distinct("terms")).alias("word"))
    counts = held.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = (F.desc("n"), F.asc("word"))
    # First the best of each part of a language's words, then of those: no task sorts all words of a language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(*order)
    best = counts.withColumn("place", F.row_number().over(part)).where(F.col("place") <= size)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= size)
    return best.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("common"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)


def _shares(counts: Column) -> Column:
    """The histogram with a sum of 1, or all 0."""
    return let(counts, lambda a: let(_total(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def _divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms given as arrays."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(_shares(counts), _shares(reference), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(_total(terms) / 2, F.lit(0.0)))


def _marks(classes: Column) -> Column:
    return F.array(*[F.get(classes, F.lit(CLASSES.index(c))) for c in MARKS])


def _repeated(found: Column, width: int) -> Column:
    """Words that lie in a window of width words which the text holds twice or more."""

    def starts(g: Column) -> Column:
        at = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return let(
            at,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"])),
                    lambda x: x["i"],
                )
            ),
        )

    def all_differ(g: Column) -> Column:
        return F.size(F.array_distinct(g)) == F.size(g)

    def count(hashes: Column) -> Column:
        return let(
            hashed_runs(hashes, width),
            lambda g: F.when(all_differ(g), F.lit(0)).otherwise(let(starts(g), lambda s: covered(s, width))),
        )

    # Texts whose shorter runs all differ, most of them, have no repeated window.
    shorter = max(w for w in (1, 2, 4, 8, 16, 32, 64) if w <= width)
    return let(
        F.transform(found, lambda x: F.xxhash64(x)),
        lambda h: F.when(let(hashed_runs(h, shorter), all_differ), F.lit(0)).otherwise(count(h)),
    )


def _common_share(counts: Column) -> Column:
    """The share of all words that the common ones are, which stand before the last."""
    return let(_shares(counts), lambda a: 1 - F.get(a, F.size(a) - 1))


def known_words(docs: DataFrame, *, listed: dict[str, list[str]] | None = None, size: int = 20, min_words: int = 10) -> DataFrame:
    """(lang, common): the listed words of languages that have a list, and what common_words() finds for all others. Only the
    documents of these are read for it."""
    listed = COMMON_WORDS if listed is None else listed
    others = docs.where(~F.coalesce("lang", F.lit("")).isin(list(listed))) if listed else docs
    fixed = docs.sparkSession.createDataFrame([(k, v[:size]) for k, v in listed.items()], "lang string, common array<string>")
    return fixed.unionByName(common_words(others, size=size, min_words=min_words))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_REFS = ("class_ref", "mark_ref", "common_ref")
_MADE = (*_COUNTS, "class_distance", "mark_distance", "common_distance", "base_failed", "kept")


def _facts(text: Column, common: Column, of_any: list[str], window: int) -> Column:
    """The histograms and the base counts of a text."""

    def facts(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        return F.struct(
            _class_counts(text, chars).alias("classes"),
            let(_terms(text), lambda t: _common_counts(t, common, of_any)).alias("common"),
            F.length(text).alias("n_chars"),
            F.size(w).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w, window).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), facts)


def _base_failed(f: Column, min_words: int, max_repeat_percent: int) -> Column:
    return (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > max_repeat_percent * f["n_words"])


def _with_facts(docs: DataFrame, common: DataFrame, window: int, max_languages: int, name: str) -> DataFrame:
    """docs with a column of facts; common, stored, is (lang, common). The driver gets some words a language."""
    of_any = [r[0] for r in common.select(F.explode("common").alias("word")).distinct().orderBy("word").collect()]
    lang, listed = free_names([*docs.columns, name], "_common_lang", "_common_list")
    common = small(common.select(F.col("lang").alias(lang), F.col("common").alias(listed)), max_languages)
    joined = docs.join(common, F.coalesce("lang", F.lit("")) == F.col(lang), "left")
    return joined.withColumn(name, _facts(F.coalesce(F.col("text"), F.lit("")), F.col(listed), of_any, window)).drop(lang, listed)


def _averaged(facts: DataFrame, f: Column, size: int) -> DataFrame:
    """Each language's mean share of each class, mark and common word. A document counts once however
    long it is, so that a few that consist of symbols do not make the reference."""
    parts = {"class_ref": (f["classes"], len(CLASSES)), "mark_ref": (_marks(f["classes"]), len(MARKS)), "common_ref": (f["common"], size + 1)}
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    shares = facts.select(lang, *[F.when(_total(c) > 0, _shares(c)).alias(name) for name, (c, _) in parts.items()])
    means = [F.avg(F.get(name, F.lit(i))).alias(f"{name}{i}") for name, (_, n) in parts.items() for i in range(n)]
    arrays = [F.filter(F.array(*[f"{name}{i}" for i in range(n)]), lambda x: x.isNotNull()).alias(name) for name, (_, n) in parts.items()]
    return shares.groupBy("lang").agg(*means).select("lang", *arrays)


def language_references(
    docs: DataFrame, *, common: DataFrame | None = None, size: int = 20, window: int = 5, min_words: int = 10, max_repeat_percent: int = 20, max_languages: int = 10_000
) -> DataFrame:
    """(lang, common, class_ref, mark_ref, common_ref): common words (see known_words, if not given as (lang, common)) and mean
    histograms over the documents of each language that pass the base rules.

    Documents without a language share the reference ''. Null and empty texts add nothing; a language
    without common words has an empty common_ref. The result may judge other documents than those it was made from."""
    common = stored(common if common is not None else known_words(docs, size=size, min_words=min_words), "common-words")
    facts = _with_facts(docs.select("lang", "text"), common, window, max_languages, "f")
    return _with_common(_averaged(facts.where(~_base_failed(F.col("f"), min_words, max_repeat_percent)), F.col("f"), size), common)


def _with_common(references: DataFrame, common: DataFrame) -> DataFrame:
    return references.join(common, "lang", "left").select("lang", "common", *_REFS)


def quality_verdicts(
    docs: DataFrame,
    *,
    keep_text: bool = True,
    references: DataFrame | None = None,
    size: int = 20,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    window: int = 5,
    min_class_chars: int = 200,
    max_class_distance: float = 0.4,
    min_marks: int = 10,
    max_mark_distance: float = 0.52,
    min_common_words: int = 50,
    max_common_distance: float = 0.55,
    min_expected_common: int = 10,
    min_common_percent: int = 10,
    max_languages: int = 10_000,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    mark_distance, common_distance, base_failed and kept; without text if keep_text is False.

    A document fails the base rules with fewer than min_words words, or if over max_repeat_percent of
    its words lie in repeated windows. Else it is kept unless the histogram of its character classes
    (from min_class_chars characters on), of those classes that mark up a text (capitals, points
    and symbols; from min_marks of them on) or of its common words (from min_common_words words on) lies
    further than the limit from the reference of its language. Nor is it kept if, of the common words that
    the reference lets expect in so many words, min_expected_common at least, it has fewer than min_common_percent.
    references is what language_references gives; without it they are made of docs, all documents that pass the base rules
    teaching them: one pass computes and stores the histograms, of which references are averaged.
    Shorter texts, and languages without a
    reference or common words, are not compared (null distance). A null text counts as empty. Rows are
    judged one by one, so repeated rows get equal verdicts and an empty table gives an empty result;
    other columns pass through, and columns that clash with the new names are replaced.
    """
    docs = docs.drop(*_MADE)
    name, lang, share, *refs = free_names(docs.columns, "_facts", "_lang", "_common_part", *[f"_{c}" for c in _REFS])
    if references is None:
        common = stored(known_words(docs, size=size, min_words=min_words), "common-words")
    else:
        references = stored(references, "language-references")
        common = references.select("lang", "common")
    facts = _with_facts(docs, common, window, max_languages, name)
    facts = stored(facts if keep_text else facts.drop("text"), "quality-facts")
    f = F.col(name)
    failed = _base_failed(f, min_words, max_repeat_percent)
    if references is None:
        references = stored(_with_common(_averaged(facts.where(~failed), f, size), common), "language-references")
    ref = references.select(F.col("lang").alias(lang), *[F.col(c).alias(r) for c, r in zip(_REFS, refs)], _common_share(F.col("common_ref")).alias(share))
    class_ref, mark_ref, common_ref = map(F.col, refs)
    out = facts.join(small(stored(ref, "language-limits"), max_languages), F.coalesce("lang", F.lit("")) == F.col(lang), "left").withColumns(
        {c: f[c] for c in _COUNTS}
        | {
            "class_distance": F.when(f["n_chars"] >= min_class_chars, _divergence(f["classes"], class_ref)),
            "mark_distance": F.when(_total(_marks(f["classes"])) >= min_marks, _divergence(_marks(f["classes"]), mark_ref)),
            "common_distance": F.when((f["n_words"] >= min_common_words) & (F.size(common_ref) > 0), _divergence(f["common"], common_ref)),
            "base_failed": failed,
        }
    )
    enough, expected = f["n_words"] >= min_common_words, f["n_words"] * F.col(share)
    rare = enough & (expected >= min_expected_common) & (100 * f["n_words"] * _common_share(f["common"]) < min_common_percent * expected)
    far = [F.col(c) > most for c, most in (("class_distance", max_class_distance), ("mark_distance", max_mark_distance), ("common_distance", max_common_distance))]
    far = [F.coalesce(x, F.lit(False)) for x in (*far, rare)]
    return out.withColumn("kept", ~(F.col("base_failed") | far[0] | far[1] | far[2] | far[3])).drop(name, lang, share, *refs)
