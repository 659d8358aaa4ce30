"""Quality rules: common words decide where capitals and punctuation are ordinary."""

import math
import random
import re

import pytest

from sparkloom.llm import quality_rules


def sentences(rng, n, lang, share):
    common = quality_rules.COMMON_WORDS[lang]
    made = ["".join(rng.choices("abdefghilmnorstu", k=rng.randint(5, 8))) for _ in range(n)]
    out = [rng.choice(common) if rng.random() < share else w for w in made]
    return " ".join(w.capitalize() + "," if i % 10 == 0 else w + "." if i % 10 == 9 else w for i, w in enumerate(out))


def test_texts_without_common_words_are_rejected(spark):
    rng = random.Random(8)
    clean = [(i, sentences(rng, rng.choice([50, 60, 100, 400]), "en", 0.3), "en") for i in range(300)]
    clean += [(1000 + i, sentences(rng, 60, "de", 0.3), "de") for i in range(100)]
    odd = [(2000 + i, sentences(rng, n, "en", 0), "en") for i, n in enumerate((60, 60, 100, 400))]
    odd += [(3000 + i, sentences(rng, 300, "de", 0.3), "en") for i in range(3)]  # in another language
    short = [(4000, sentences(rng, 45, "en", 0), "en")]
    df = spark.createDataFrame(clean + odd + short, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert not any(out[i].kept or out[i].base_failed for i, *_ in odd)
    assert all(out[i].class_distance < 0.4 and out[i].mark_distance < 0.52 for i, *_ in odd)
    assert all(out[i].kept for i, *_ in clean + short)


def test_other_languages_learn_their_words(spark):
    rng = random.Random(8)
    listed = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    made = lambda n, share: " ".join(rng.choice(listed) if rng.random() < share else "".join(rng.choices("abdefghilmnorstu", k=7)) for _ in range(n))
    rows = [(i, made(80, 0.4), "xx") for i in range(80)] + [(500, made(80, 0), "xx"), (501, made(80, 0), "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang: sorted(r.common) for r in quality_rules.common_words(df).collect() if r.lang == "xx"} == {"xx": sorted(listed)}
    assert {r.doc_id for r in quality_rules.quality_verdicts(df).collect() if not r.kept} == {500}


def test_marks_and_capitals_do_not_hide_common_words(spark):
    text = "THE, (of) and. 'To' in! " * 20
    row = quality_rules.language_references(spark.createDataFrame([(1, "x", None), (2, text + "zebra " * 100, "en")], "doc_id long, text string, lang string"), max_repeat_percent=100)
    en = next(r for r in row.collect() if r.lang == "en")
    assert [round(x, 3) for x in en.common_ref] == [0.1] * 5 + [0] * 15 + [0.5]


def distance(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))


def test_distances_and_references_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, sentences(rng, rng.randint(60, 90), "en", 0.3), "en") for i in range(20)]
    rows += [(50, "junk " * 60, "en"), (51, "### ### " * 3, "en")]  # fail the base rules, so teach nothing
    out = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def histograms(text):
        n = [len(re.findall(f"[{c}]", text)) for c in quality_rules.CHAR_CLASSES.values()]
        n += [sum(c in " \n" for c in text)]
        n += [len(text) - sum(n)]
        terms = [t for t in re.split(quality_rules.AROUND, text.lower()) if t]
        common = [terms.count(w) for w in quality_rules.COMMON_WORDS["en"]]
        return [[x / max(sum(h), 1) for x in h] for h in (n, [n[0], n[2], n[3]], [*common, len(terms) - sum(common)])]

    taught = [histograms(t) for i, t, _ in rows if i < 50]
    reference = [[sum(x) / len(taught) for x in zip(*(h[k] for h in taught))] for k in range(3)]
    for i, text, _ in rows[:20]:
        want = [distance(p, q) for p, q in zip(histograms(text), reference)]
        assert [out[i].class_distance, out[i].mark_distance, out[i].common_distance] == pytest.approx([w if k != 1 or sum(c in text for c in ".,") else None for k, w in enumerate(want)])


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "en", "x", "y", "z")], "doc_id long, text string, lang string, _lang string, _class_ref string, _facts string")
    row = quality_rules.quality_verdicts(df).first()
    assert (row["_lang"], row["_class_ref"], row["_facts"], row.kept) == ("x", "y", "z", False)


def test_rare_common_words_prove_nothing(spark):
    rng = random.Random(8)
    rows = [(i, sentences(rng, 60, "en", 0.02), "en") for i in range(60)] + [(100, sentences(rng, 60, "en", 0), "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.kept for r in quality_rules.quality_verdicts(df).collect())
