"""Spelling variants, source divergence and personal data against brute force, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import divergence_audit, private_data, spelling

SCHEMA = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# spelling variants


def variants(rows):
    """{word: (n, n_near, form, form_n, root)} by looking at all pairs."""
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    form, n_near = {}, {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n, n_near[w], form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def spelt(spark, rows):
    out = spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in out.collect()}


def test_spelling_groups(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(25)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(stems[: 1 + int(25 * rng.random() ** 3)])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "é", "ab"]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(i, "chainaaaa " * 40 + "chainaaab " * 4) for i in range(500, 510)] + [(510, "chainaabb chainaabb chainaabb")]
    rows += [(None, stems[0] + " " + stems[1]), (5, None), (6, ""), (7, "short aaaaaa"), rows[3], rows[3]]
    got = spelt(spark, rows)
    assert got == variants(rows)
    assert sum(v[2] is not None for v in got.values()) > 20 and any(v[2] != v[4] for v in got.values() if v[2])


def test_long_words_are_keyed_by_digests(spark):
    rng = random.Random(3)
    for length in (62, 63, 64, 65, 66, 67, 300):
        base = "".join(rng.choices("abcde", k=length))
        near = [base[:10] + "x" + base[11:], base[:20] + base[21:], base[:5] + "y" + base[5:], base[: length - 1], "z" + base]
        rows = [(i, f"{base} " * 40) for i in range(3)] + [(10 + i, f"{w} {w}") for i, w in enumerate(near)]
        assert spelt(spark, rows) == variants(rows)
    letters = "ab" * 20_000  # in time linear in its length
    assert len(spelling._digests(letters)[0]) == 40_000


def test_spelling_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(empty).count() == 0
    clash = spark.createDataFrame([(1, "someword someword", 3, "x")], "doc_id long, text string, n long, `a.b` string")
    assert [r["word"] for r in spelling.spelling_groups(clash).collect()] == ["someword"]
    with pytest.raises(ValueError):
        spelling.spelling_groups(empty, ratio=1)


def test_no_window_holds_a_pair_for_each_two_words(spark):
    """A group of wildcards has a row a word, so rows grow with the words and not with their pairs."""
    words = spark.createDataFrame([(f"commonw{chr(97 + i)}{chr(97 + j)}", 2) for i in range(26) for j in range(26)], "word string, n long")
    assert spelling.keys(words).where("kind = 'wild'").count() == 676 * 9
    assert {r["n_near"] for r in spelling.near_words(words).collect()} == {50}


# source divergence


def audit(rows, least=10):
    """The rows of the contract, in whole numbers."""
    groups = sorted({(lang or "", source or "") for _, _, lang, source in rows})
    n, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        own = [g for g in groups if g[0] == lang]
        total = collections.Counter()
        for g in own:
            total.update({t: n[g][t] for t in kept})

        def shares(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // whole for t in kept}

        q, p = shares(total), {g: shares(n[g]) for g in own}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = sorted(((-sum(gap(p[g][t], p[o][t]) for t in kept), o[1].encode(), o[1]) for o in own if o != g))
            out += [(*g, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(pairs)]
            terms = sorted((-gap(p[g][t], q[t]), t.encode(), t) for t in kept if n[g][t] > 0 and p[g][t] > q[t])
            out += [(*g, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(terms[:10])]
    return sorted(out)


def audited(spark, rows, **options):
    out = divergence_audit.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


def test_source_divergence(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abÉ漢", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocab[: 20 + 2 * (i % 20)], k=rng.randint(0, 30))) + "!", rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "c", "é"])) for i in range(400)]
    rows += [(1, None, "en", "silent"), (2, "", "none", "x"), (3, "one word", "none", "y"), (4, "alone", "single", "z"), rows[0], rows[0], (5, vocab[0] * 1 + " X" * 50_000, "fr", "long")]
    want = audit(rows)
    assert audited(spark, rows) == want
    assert audited(spark, rows, block=2) == want


def test_source_divergence_odd_tables(spark):
    assert audited(spark, [(1, None, None, None)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence_audit.source_divergence(empty).count() == 0
    clash = spark.createDataFrame([(1, "b", "en", "s", 1, 2), (2, "b", "en", "t", 1, 2)], SCHEMA + ", n long, `a.b` int")
    assert divergence_audit.source_divergence(clash, min_docs=1).where("part = 'pair'").count() == 2


def test_first_terms_are_taken_before_a_group_is_gathered(spark):
    rows = [(i, "a b", "en", f"s{i % 2}") for i in range(20)]
    out = divergence_audit.source_divergence(spark.createDataFrame(rows, SCHEMA))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_counts_of_texts_in_pieces():
    text = ("ab é9" * 50_000).encode()
    pieces = [t for part in divergence_audit._pieces(text) for t in part]
    assert pieces == re.findall(rb"[a-z\x80-\xff]+", text)


# personal data

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if ok[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def private(spark, rows):
    out = private_data.private_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["spans"]))


def test_base_spans_of_hostile_texts(spark):
    rng = random.Random(9)
    pieces = ["a@b.c", "a@b", "@", ".", "_d@e.f", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111112", "+1 (988) 555-2485", "+", "12", "-", " ", "  ", "é", "漢", "x", "(", ")", "\n", "%", "+44 20 7946 0958", "1.1.1.1.1", "a@b.c.d..e"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 25)))) for i in range(600)]
    rows += [(601, None), (602, ""), (602, "a@b.c"), (602, "a@b.c"), (603, "1" * 30_000), (604, "a" * 30_000), (605, "1." * 15_000), (606, "a@" + "b." * 15_000 + "c"), (607, "1 " * 15_000), (608, "+1" + "(" * 30_000), (None, "x 1.2.3.4")]
    got = private(spark, rows)
    assert len(got) == len(rows)
    want = sorted(((i, base_spans(t)) for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, joined(x[1])))
    for r, (doc_id, spans) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"])), sorted(want, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(joined(x[1]).encode()).hexdigest()))):
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert tuple(r[f"n_{k}"] for k in KINDS) == tuple(sum(s[0] == k for s in spans) for k in KINDS)
        assert set(joined(spans).split(",")) <= set(r["spans"].split(","))


def card(rng):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))


def test_learned_spans_are_what_base_missed(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04}"
    rows, missed = [], {}
    for i in range(1500):
        what = [phone, lambda: card(rng), lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), lambda: f"{word()}.{rng.randrange(99)}@mail.example.com", lambda: f"token={rng.getrandbits(120):x}"][i % 5]()
        rows.append((i, f"{word()} {word()} {what} {word()}"))
    for i in range(1500, 1540):  # a card behind a phone is one run of too many digits, so base takes neither
        p, c = phone(), card(rng)
        text = f"{word()} {p} {c} {word()}"
        if not base_spans(text):
            missed[i] = joined([("card", text.index(c), text.index(c) + 16), ("phone", text.index(p), text.index(p) + len(p))])
            rows.append((i, text))
    rows += [(2000 + i, f"{word()} {rng.getrandbits(160):x} {word()} {rng.randrange(10**6)}") for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in private(spark, rows)}
    assert len(missed) > 20
    for i, text in rows:
        assert got[i] == missed.get(i, joined(base_spans(text))), text


def test_no_documents_and_clashing_columns(spark):
    assert private_data.private_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "a@b.cd", 3, "y")], "doc_id long, text string, row int, `a.b` string")
    out = private_data.private_spans(clash).collect()
    assert [(r["n_email"], r["spans"]) for r in out] == [(1, "email:0:6")]


def test_trees_follow_the_gains(spark):
    """The first split of one round is that of the largest gain, by hand, and its margins are the shrunken Newton steps; a node
    that no split betters stays whole."""
    rows = [{n: 0 for n in private_data.FEATURES} | {"n_digits": d, "has_cue": c, "yes": y, "no": n} for d, c, y, n in ((9, 0, 30, 1), (9, 1, 20, 0), (12, 0, 2, 40), (12, 1, 10, 9))]
    cases = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} long" for k in rows[0]))
    margin = private_data.fit_trees(cases, rounds=1, rate=1.0, ridge=1.0)
    got = {(r["n_digits"], r["has_cue"]): r["m"] for r in cases.withColumn("m", margin).select("n_digits", "has_cue", "m").collect()}
    step = lambda y, n: (y - n) / 2 / ((y + n) / 4 + 1)
    assert got == pytest.approx({(9, 0): step(50, 1), (9, 1): step(50, 1), (12, 0): step(2, 40), (12, 1): step(10, 9)}, abs=1e-5)


def test_thresholds_keep_their_precision(spark):
    cases = spark.createDataFrame([(0, 900, 98, 0), (0, 800, 100, 1), (0, 700, 10, 50), (1, 900, 3, 0), (2, 10, 0, 5)], "kind_no int, s int, yes long, no long")
    assert private_data.thresholds(cases, F.col("s"), 0.98) == {"email": 800}
