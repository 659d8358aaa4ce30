"""Near copies by shingle similarity, against brute force over all pairs."""

import random

import corpus_pipeline
from sparkloom.llm import common, near_copies, simhash
from tests.llm.test_text_operators import SCHEMA, corpus

COLUMNS = "doc_id long, text string"


def alike(rows):
    """The rows that stay, by brute force."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(least.values())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_drops_near_copies_of_short_and_long_texts(spark):
    rng = random.Random(4)
    texts = []
    for n_words in (12, 30, 64, 150, 400):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
            texts += [" ".join(words), " ".join(words[:-1]), edited(rng, words, max(1, n_words // 60)), edited(rng, words, max(1, n_words // 20))]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(len(rows) + i, t, "en", "s", 0) for i, t in enumerate([None, "", " \t", "one", "One", "one two"])]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    want = alike(rows)
    assert sorted(r.doc_id for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == want and len(want) < 200


def test_chains_and_large_groups(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 1 + i % 3)) for i in range(150)]
    text = [f"c{i}" for i in range(100)]
    for i in range(8):  # each is near only to its neighbours
        rows.append((1000 + i, " ".join(text)))
        text = text[8:] + [f"c{i}x{j}" for j in range(8)]
    rows += [r[:2] for r in corpus() if r[0] != 154 and r[1]]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = near_copies.one_of_each(spark.createDataFrame(rows, COLUMNS).repartition(7))
    assert sorted(r.doc_id for r in got.collect()) == alike(rows)


def test_order_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "x y"), (None, "x y")], COLUMNS)
    assert sorted(map(tuple, near_copies.one_of_each(df).collect()), key=str) == [(4, "a b c"), (None, "x y")]
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_texts_that_each_differ_in_their_own_places_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(400):  # two of these share about 0.64 of their shingles, so few pairs are near
        words = list(base)
        for at in (rng.randrange(45), 45 + rng.randrange(45)):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    compared, similar = [], near_copies._similar

    def counted(pairs, sets, min_percent):
        compared.append(pairs.count())
        return similar(pairs, sets, min_percent)

    monkeypatch.setattr(near_copies, "_similar", counted)
    got = near_copies.one_of_each(spark.createDataFrame(rows, COLUMNS))
    assert sorted(r.doc_id for r in got.collect()) == alike(rows)
    assert sum(compared) < 400 * 399 / 2 / 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 0, 7), (2, "a b c", 0, 8)], "doc_id long, text string, `a.b` int, _copy_key int")
    assert [r.asDict() for r in near_copies.one_of_each(df).collect()] == [{"doc_id": 1, "text": "a b c", "a.b": 0, "_copy_key": 7}]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    names, kept = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: names.append(name) or kept(df, name))
    stars = spark.createDataFrame([(1, 2), (3, 1), (1, 2), (5, 9), (4, 4)], "a long, b long")
    assert {tuple(r) for r in common.components(stars, "links").collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)}
    assert names == ["links"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (31, 40)], "a long, b long")
    assert {tuple(r) for r in common.components(chain, "links").collect()} == {(i, 0) for i in range(21)} | {(i, 30) for i in (30, 31, 40)}


def test_groups_over_fingerprints_and_shingles_are_found_once(spark, monkeypatch):
    names, kept = [], simhash.components
    for module in (near_copies, simhash):
        monkeypatch.setattr(module, "components", lambda edges, name: names.append(name) or kept(edges, name))
    words = [f"w{i}" for i in range(300)]
    rows = [(2, " ".join(words)), (1, " ".join([*words[:-1], "end"])), (3, "quite another text of some words"), (4, " ".join(words))]
    assert sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=3).collect()) == [1, 3]
    assert names == ["near-copy-components", "near-copy-groups"]


def test_links_under_another_name(spark):
    prints = spark.createDataFrame([(0, 70), (7, 80), (15, 90), (1 << 40, 60)], "fp long, name long")
    plain = {tuple(r) for r in simhash.links(prints).collect()}
    assert plain == {(0, 7), (7, 15), (0, 1 << 40)}
    of = {0: 70, 7: 80, 15: 90, 1 << 40: 60}
    for crowded in (500, 1):
        assert {tuple(r) for r in simhash.links(prints, name="name", crowded=crowded).collect()} == {(of[a], of[b]) for a, b in plain}
