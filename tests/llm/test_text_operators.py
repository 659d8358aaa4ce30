"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
import xxhash

from sparkloom.llm import attention_quality as aq
from sparkloom.llm import chat, decontaminate, html_text, language_id, line_templates, mixing, quality_rules, simhash, url_rules

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijé", k=rng.randint(2, 6))) for _ in range(150)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.append(f"the shared line of number {rng.randint(1, 99)} stands in many texts")
        if i % 7 == 0:
            lines.append("exactly the same line of nine words stands here")
        if i % 11 == 0:
            lines = lines[:1] * 6
        if rows and i % 5 == 0:
            lines = rows[rng.randrange(len(rows))][1].split("\n") + ["A b"] * (i % 2)
        rows.append((i, "\n".join(lines)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "a!"), (n + 4, " ".join(rng.choices(vocab, k=5000))), (n + 4, "one more row of the same id, with other words in it")]
    return [(i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s1"][i % 4], len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


def counted(rows_of):
    return collections.Counter(map(tuple, rows_of))


# quality rules


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen = collections.defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("keep_text", [True, False])
def test_quality_counts(docs, rows, keep_text):
    out = quality_rules.quality_verdicts(docs.withColumnRenamed("n_chars", "kept"), keep_text=keep_text)
    got = counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = counted((r[0], *b, b[0] < 10 or 100 * b[4] > 20 * b[0]) for r in rows for b in [base(r[1])])
    assert got == want


def test_quality_divergence(spark):
    rng = random.Random(5)
    clean = [(i, " ".join(rng.choices("the of and house walks river stone to in a".split(), k=80)) + ".", "en") for i in range(60)]
    odd = [(100, "### *** $$$ %%% " * 60, "en"), (101, " ".join(str(rng.random()) for _ in range(80)), "en"), (102, "THE! OF!! AND!! HOUSE!! " + "".join(f"W{rng.choice('ABCDEF')}{i}!! " for i in range(80)), "en")]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert all(out[i].kept for i, *_ in clean) and not any(out[i].kept for i, *_ in odd)
    assert all(0 <= r.class_distance <= 1 for r in out.values())


def test_quality_empty(spark, docs):
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0


# html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One,  two<br>three &amp; four.<p>Five</article><footer>f</footer>", "Title\nOne, two three & four.\nFive"),
        ("<body><header><h1>Site</h1></header><div id=content><p>First, longer paragraph, of the article.</p><ul><li>item one</li><li>item two</li></ul></div><div class='comments'><p>Nice, good, fine, and more of it!</p></div></body>", "First, longer paragraph, of the article.\nitem one\nitem two"),
        ("<article>Text<script>x('</p>')</script> on<!-- no --> one line<form><input>Sign</form><aside>side</aside></article>", "Text on one line"),
        ("<div class='cookie-notice'>We use cookies, many, many, many.</div><main><p>Short.</p></main>", "Short."),
        ("<article><p>A</p><article><p>A reader's comment, long, with commas, indeed.</p></article></article>", "A"),
        ("<p hidden>x</p><div><p>a <a href=u>b</a>c</p></div>", "a bc"),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_linear_time_and_table(spark):
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"
    assert html_text.main_text("<a '" * 20000) is not None
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert counted(html_text.extract_text(df).collect()) == counted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)])
    assert html_text.extract_text(df.limit(0)).count() == 0


# decontamination


def hits(text, windows):
    words = re.findall(ALNUM, lower(text or ""))
    hit, found = set(), set()
    for k in {len(w) for w in windows}:
        for i in range(len(words) - k + 1):
            for item in windows.get(tuple(words[i : i + k]), ()):
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), found


def test_decontamination(spark, docs, rows):
    rng = random.Random(1)
    whole = [r[1] for r in rows if r[1] and len(r[1].split()) > 12]
    items = [(i, " ".join(rng.choice(whole).split()[2 : 2 + rng.randint(1, 30)]).upper() + " zzz" * (i % 2)) for i in range(25)]
    items += [(90, "same LINE, of nine words"), (91, "Same line of: nine words"), (92, None), (93, ""), (94, "---")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, lower(t or ""))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add(str(i))
    out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = counted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
    want = counted((r[0], n, h, len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), h > 0) for r in rows for n, h, f in [hits(r[1], windows)])
    assert got == want and any(k[2] for k in want)


def test_decontamination_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(docs, none).where("contaminated").count()
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# attention


def test_attention_learns_and_covers_every_row(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(200)]

    def text(good, n):
        words = rng.choices(vocab, k=n)
        return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)

    data = [(i, text(i % 3 > 0, rng.randint(5, 300)), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (902, "x " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 300] + [(None, 1), (5000, None)], "doc_id long, label int")
    model = aq.fit(docs, labels)
    out = {r.doc_id: r for r in aq.score_quality(docs, model).collect()}
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert sum(out[i].predicted == y for i, _, y in data if i >= 300) >= 97
    again = aq.fit(docs.repartition(7), labels)
    assert abs(again.score("Abc def. Ghi") - model.score("Abc def. Ghi")) < 1e-9


def test_attention_gradient_and_weights():
    import numpy as np

    rng = np.random.default_rng(0)
    m = aq.Model(np.zeros(3), np.ones(3), rng.normal(size=(3, 2)), rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=3), 0.1)
    h = rng.normal(size=(5, 3))
    _, _, a, z, p = m.parts(h, np.array([0, 2]))
    e = (np.tanh(h @ m.v) / (1 + np.exp(-h @ m.u))) @ m.w
    want = np.exp(e[2:]) / np.exp(e[2:]).sum()
    assert np.allclose(a[2:], want) and np.allclose(z[1], want @ h[2:]) and np.allclose(p[1], 1 / (1 + np.exp(-(z[1] @ m.c + 0.1))))


def test_attention_gradient_is_that_of_the_loss(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    bags, labels = [rng.normal(size=(n, 4)) for n in (1, 3, 5)], np.array([1.0, 0.0, 1.0])
    first = {}
    real = aq.Model.__setattr__
    monkeypatch.setattr(aq.Model, "__setattr__", lambda m, k, v: (first.setdefault(k, []).append(np.array(v, float)), real(m, k, v))[1])
    rate = 1e-3
    aq.train(bags, labels, passage=50, hidden=2, epochs=1, rate=rate, decay=0.0, batch=3, seed=5)
    monkeypatch.undo()
    x = np.concatenate(bags)
    scaled = [np.clip((b - x.mean(axis=0)) / x.std(axis=0), -8, 8) for b in bags]

    def loss(params):
        m = aq.Model(np.zeros(4), np.ones(4), *[params[k] for k in ("v", "u", "w", "c", "b")])
        p = m.parts(np.concatenate(scaled), np.array([0, 1, 4]))[-1]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    # Adam's first step moves every weight by rate against the sign of its gradient.
    start = {k: first[k][0] for k in ("v", "u", "w", "c", "b")}
    for k in start:
        moved = (first[k][1] - start[k]).ravel()
        for i in range(start[k].size):
            around = []
            for step in (1e-5, -1e-5):
                p = {n: a.copy() for n, a in start.items()}
                p[k] = p[k].ravel()
                p[k][i] += step
                p[k] = p[k].reshape(start[k].shape)
                around.append(loss(p))
            slope = (around[0] - around[1]) / 2e-5
            if abs(slope) > 1e-6:
                assert moved[i] == pytest.approx(-rate * np.sign(slope), rel=1e-2)
            else:
                assert abs(moved[i]) <= rate * 1.01


def test_attention_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(aq, "train", lambda bags, y, **_: seen.append((len(bags), sum(map(len, bags)), max(map(len, bags)))))
    rows = [(7, f"word {i} " * 30) for i in range(3000)] + [(i + 10, "some words. " * 50 * (1 + i % 3)) for i in range(60)] + [(500, "w " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (500, 1), *((i + 10, i % 2) for i in range(60))], "doc_id long, label int")
    aq.fit(docs, labels, max_documents=2000, max_passages=1500)
    aq.fit(docs, labels, max_documents=20)
    aq.fit(docs, labels.where("doc_id <> 7"), max_documents=2000)
    assert seen[0][1] <= 1500 and seen[0][2] <= 75 and seen[1][0] <= 20
    assert seen[2][2] == 400  # all passages of a long text


def test_attention_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert aq.fit(docs, none) is None
    assert aq.score_quality(docs, None).where("score = 0.5").count() == docs.count()


# line templates


def tokens(line):
    raw = tuple(re.findall(r"[^\x20\x09\x0B-\x0D]+", line))
    masked = tuple("<*>" if re.search("[0-9]", w) else w for w in raw)
    return raw if len(raw) < 8 or set(masked) == {"<*>"} else masked


def deduplicated(rows):
    lines = [(r[0], [(x, tokens(x)) for x in r[1].split("\n")]) for r in rows if r[1] is not None]
    held, count, leaves = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for i, own in lines:
        for _, t in own:
            if t:
                held[t].add(i)
                count[t] += 1
                if len(t) >= 8:
                    leaves[len(t), t[:4]].add(t)
    template = {}
    for leaf, kinds in leaves.items():
        if len(kinds) > 1:
            votes = [collections.Counter() for _ in range(leaf[0])]
            for t in kinds:
                for place, token in enumerate(t):
                    votes[place][token] += count[t]
            usual = [max((n, x.encode()) for x, n in v.items())[1].decode() for v in votes]
            template |= {t: leaf for t in kinds if sum(a == b for a, b in zip(t, usual)) >= 0.8 * len(t)}
            rest = [t for t in kinds if t not in template]
            context = collections.defaultdict(set)
            runs = lambda t: [((i, k, t[i - 1], t[i + k : i + k + 1]), t[i : i + k]) for k in (1, 2, 3) for i in range(4, len(t) - k + 1)]
            for t in rest:
                for key, run in runs(t):
                    context[key].add(run)
            for t in rest:
                varied = collections.Counter()
                for key, _ in runs(t):
                    if all(len({run[end] for run in context[key]}) > 1 for end in (0, -1)):
                        for i in range(key[0], key[0] + key[1]):
                            varied[i] = max(varied[i], len(context[key]))
                fields = sorted(varied, key=lambda i: (-varied[i], i))[: len(t) - -(-8 * len(t) // 10)]
                if fields:
                    template[t] = (leaf, tuple("<*>" if i in fields else x for i, x in enumerate(t)))
    sizes = collections.Counter(template.values())
    template = {t: x for t, x in template.items() if sizes[x] > 1}
    whole = collections.defaultdict(set)
    for t, own in held.items():
        whole[template.get(t, t)] |= own
    gone = lambda i, t: bool(t) and min(whole[template.get(t, t)]) != i
    return counted((i, "\n".join(x for x, t in own if not gone(i, t)), len(own), sum(gone(i, t) for _, t in own)) for i, own in lines)


def test_line_templates(docs, rows):
    out = line_templates.dedup_lines(docs).collect()
    got = counted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out if r.text is not None)
    want = deduplicated(rows)
    assert got == want and any(k[3] for k in want) and len(out) == len(rows)


def test_line_templates_edges(spark, docs):
    same = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(2, f"{same}\nx"), (1, same), (None, same), (3, f"one two  three four\tfive six seven eight nine\n{same}")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.dedup_lines(df).collect()}
    assert out == {1: (same, 0), 2: ("x", 1), None: (same, 0), 3: ("", 2)}
    assert line_templates.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_recur(spark):
    df = spark.createDataFrame([(i, f"Accept all cookies\nbody {'x' * i}\n\n12 of 7") for i in range(1, 6)], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.dedup_lines(df).collect()}
    assert out == {1: ("Accept all cookies\nbody x\n\n12 of 7", 0)} | {i: (f"body {'x' * i}\n", 2) for i in range(2, 6)}


def test_two_templates_share_a_leaf(spark):
    first, second = "we sell the best {} in all of the town today", "we sell the best of fruit and {} to our guests"
    rows = [first.format(x) for x in ("bread", "wine", "cake")] * 3 + [second.format(x) for x in ("beer", "salt")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = line_templates.dedup_lines(df).collect()
    assert {r.doc_id for r in out if not r.n_dropped} == {0, 9}


@pytest.mark.parametrize("others", [[], ["the daily report of the weather that was read by many people in town"] * 30, ["the daily report of user ann has never sent to city rome right now"] * 30])
def test_templates_do_not_depend_on_their_neighbours(spark, others):
    rows = [f"the daily report of user {u} has been sent to city {c} right now" for u in ("ann", "bob", "cid", "dot") for c in ("rome", "oslo", "lima")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows + others)], "doc_id long, text string")
    out = line_templates.dedup_lines(df).collect()
    assert sum(r.n_dropped for r in out if r.doc_id < 12) == 11
    assert sum(r.n_dropped for r in out if r.doc_id >= 12) == max(len(others) - 1, 0)


def test_fields_side_by_side(spark):
    rows = ["we sell the best of all the fruit in this town"] * 9 + [f"we sell the best wine of {a} {b} to all our guests" for a, b in (("ann", "poe"), ("bob", "roe"), ("cid", "soe"))]
    out = line_templates.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if not r.n_dropped} == {0, 9}


def test_table_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "1 2 3 4 5 6 7 8", "a"), (2, "9 8 7 6 5 4 3 2", "b"), (3, "9 8 7 6 5 4 3 2", "c")], "doc_id long, text string, _line_drop string")
    out = line_templates.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_line_drop", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_dropped, r["_line_drop"]) for r in out.collect()) == [(1, 0, "a"), (2, 0, "b"), (3, 1, "c")]


# url rules


def test_urls(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), ("broken", "block"), ("a.org/", "block"), ("a.org/", "allow")]
    urls = ["http://A.Example.NET/en/x?y", "http://example.net/EN/", "https://net", "ftp://xnet/", "http://b.example.com/de/#a", "http://a.org:80/", "http://x.a.org/fr/1", "nothing", None, "", "://", "http://example.com/d"]
    out = url_rules.judge_urls(spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id int, url string, rule string"), spark.createDataFrame(rules, "rule string, verdict string"))

    def judge(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        best = None
        for rule, verdict in [r for r in rules if r[0] and "/" in r[0]]:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (not best or (len(rule), verdict) > (len(best[0]), best[1])):
                best = (rule, verdict)
        return host, path, best[0] if best else None, best[1] if best else "allow"

    assert counted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()) == counted([(i, *judge(u)) for i, u in enumerate(urls)] + [(0, *judge(urls[0]))])
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id int, url string"), spark.createDataFrame([], "rule string, verdict string")).count() == 0


# mixing


def shares(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing(spark, docs, rows):
    out = mixing.mix(docs, chunk=8).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    assert counted((r.doc_id, r.size, r.source) for r in out) == counted((r[0], size(r[1]), r[3]) for r in rows)
    total, taken = collections.Counter(), collections.Counter()
    for r in out:
        total[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
    want = shares(total)
    largest = max(r.size for r in out)
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r.target) <= largest / 2 + 1e-6
    again = mixing.mix(docs.repartition(3), chunk=8).collect()
    assert counted((r.doc_id, r.size, r.taken) for r in again) == counted((r.doc_id, r.size, r.taken) for r in out)


def test_mixing_edges(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " ", None)], "doc_id long, text string, source string")
    assert counted((r.doc_id, r.size, r.taken) for r in mixing.mix(df).collect()) == counted([(1, 0, 0), (2, 0, 0), (3, 0, 0)])


def test_repeated_rows_are_units_of_their_own(spark):
    df = spark.createDataFrame([(1, "five words stand in here", "a")] * 40 + [(2, "a b c", "a"), (3, "a", "a"), (4, "a b", "a")], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 43 and out[0].target == pytest.approx(1.5 * 206)
    assert abs(sum(r.taken for r in out) - out[0].target) <= 2.5
    together = mixing.mix(df, each=False).collect()
    assert len(together) == 43 and len({r.copies for r in together if r.doc_id == 1}) == 1
    assert counted(mixing.mix(df.repartition(5)).collect()) == counted(out)


# language


def test_a_language_of_one_text_is_learned(spark):
    rows = [(i, "shab thog ungo lith", "xx") for i in range(200)] + [(300 + i, f"être çoù ñando {'ab'[i % 2]}", "yy") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert set(language_id.learn_profiles(df, max_documents=5)) == {"xx", "yy"}


def test_language(spark):
    rng = random.Random(4)
    words = {"xx": ["shab", "thog", "ungo", "lith"], "yy": ["être", "çoù", "ñando", "ués"]}
    data = [(i, " ".join(rng.choices(words[x], k=rng.randint(3, 30))), x) for i, x in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame(data + [(500, None, None), (501, "12 !", "xx"), (502, "", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(df.where("doc_id % 3 <> 1"))
    assert set(profiles) == {"xx", "yy"}
    out = {r.doc_id: r for r in language_id.predict_language(df, profiles).collect()}
    assert all(out[i].lang_pred == x and 0 <= out[i].score <= 1 for i, _, x in data)
    assert all(out[i].lang_pred == "und" for i in (500, 501, 502))
    assert language_id.predict_language(df, {}).where("lang_pred <> 'und'").count() == 0


def test_language_rank_distance():
    grams, counts = language_id.gram_counts("aab")
    ranked = language_id.top_grams(grams, counts, 3)
    want = collections.Counter(g for n in (1, 2, 3) for i in range(6 - n) for g in [" aab "[i : i + n]] if g != " ")
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    assert ranked.tolist() == [code(g) for g, _ in sorted(want.items(), key=lambda x: (-x[1], code(x[0])))[:3]]


def test_language_out_of_place_distance(spark):
    """Scores and winners against the distance computed from its definition; of equal sums the first language wins."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    taught = [(i, " ".join(rng.choices(vocab[k * 15 : k * 15 + 25], k=40)), x) for i in range(6) for k, x in enumerate(["cc", "aa", "bb"])]
    taught += [(99, taught[0][1], "ac"), (99, taught[3][1], "ac"), (99, taught[6][1], "ac")]
    df = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(df, size=40) | {}
    profiles["ab"] = profiles["cc"]  # a tie
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)

    def ranked(text, size):
        line = " " + re.sub(r"[^a-zé]+", " ", (text or "").lower()).strip() + " "
        n = collections.Counter(line[i : i + k] for k in (1, 2, 3) for i in range(len(line) - k + 1))
        del n[" "]
        return [code(g) for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    texts = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 30)))) for i in range(60)]
    out = {r.doc_id: r for r in language_id.predict_language(spark.createDataFrame(texts, "doc_id long, text string"), profiles).collect()}
    for i, text in texts:
        own = ranked(text, 40)
        costs = {x: sum(abs(p.index(g) - k) if g in p else 40 for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(costs), key=costs.get)
        assert (out[i].lang_pred, out[i].score) == (best, pytest.approx(1 - costs[best] / (40 * len(own))))
    assert "cc" not in {r.lang_pred for r in out.values()}


def test_language_of_texts_longer_than_a_part(monkeypatch):
    text = "Un été, à la plage. " * 40 + "ß" * 7
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "_CHUNK", 16)
    parts = language_id.gram_counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


# simhash


def print_of(text):
    w = re.findall(WORD, lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(rows):
    prints = {(r[0], r[1]): print_of(r[1]) for r in rows}
    kinds = sorted(set(prints.values()))
    root = {p: p for p in kinds}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (i, _), p in prints.items():
        least[find(p)] = min(least.get(find(p), i), i)
    return {k: (f"{p:016x}", least[find(p)]) for k, p in prints.items()}


def test_simhash(docs, rows):
    want = groups(rows)
    out = simhash.near_duplicates(docs).collect()
    assert counted((r.doc_id, r.fingerprint, r.component_id) for r in out) == counted((r[0], *want[r[0], r[1]]) for r in rows)
    assert len({v[1] for v in want.values()}) < len(rows)


def test_simhash_links(spark):
    rng = random.Random(9)
    base_prints = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base_prints)
    for p in base_prints:
        for bits in (1, 2, 3, 4, 5):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert got == {(r.a, r.b) for r in simhash.links(df, crowded=2).collect()}
    ps = sorted(map(signed, prints))
    want = {(a, b) for i, a in enumerate(ps) for b in ps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want and len(want) >= 100


def test_simhash_links_with_common_halves(spark):
    """Many fingerprints share a half, exactly or but for a bit, so that one value of a segment is crowded."""
    rng = random.Random(19)
    prints = {(0xABCD1234 ^ (1 << rng.randrange(40) & 0xFFFFFFFF)) << 32 | rng.choice([rng.getrandbits(32), rng.getrandbits(6), 0xF0F0 << rng.randrange(8)]) for _ in range(900)}
    prints |= {rng.getrandbits(32) << 32 | 0x7777AAAA for _ in range(600)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    ps = sorted(map(signed, prints))
    want = {(a, b) for i, a in enumerate(ps) for b in ps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(p,) for p in ps], "fp long")
    assert {(r.a, r.b) for r in simhash.links(df, crowded=50).collect()} == want and len(want) > 500


def test_simhash_one_of_each(spark, docs, rows):
    want = groups(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    # The two rows of id 154 hold different texts, each its group's first.
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*{v[1] for v in want.values()}, 154])
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert counted(simhash.one_of_each(df).collect()) == counted([(4, "a b c"), (None, "x y")])
    assert simhash.one_of_each(docs.limit(0)).count() == 0


# chat


def test_chat(spark):
    rng = random.Random(6)
    convs = {}
    for i in range(40):
        convs[i] = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0 and i:
            convs[i] = convs[i - 1] + [("user", "more")]
        if i % 8 == 7:
            convs[i] = list(convs[i - 7])
    turns = [(i, t, r, x, "extra") for i, own in convs.items() for t, (r, x) in enumerate(own)]
    df = spark.createDataFrame(turns + turns[:3] + [(None, 0, "user", "x", "e")], "conv_id long, turn long, role string, text string, n_turns string").repartition(4)
    want = {}
    for i, own in convs.items():
        if not any(len(o) > len(own) and o[: len(own)] == own for o in convs.values()):
            want.setdefault(tuple(own), []).append(i)
    rendered = lambda own: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in own)
    assert counted(chat.chat_texts(df).collect()) == counted((min(ids), len(own), len(ids), rendered(own)) for own, ids in want.items())
    assert chat.chat_texts(df.limit(0)).count() == 0
