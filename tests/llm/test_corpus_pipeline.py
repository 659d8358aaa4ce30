"""The pipeline stage by stage on small tables, each against what its operator's brute force keeps."""

import collections
import re

import corpus_pipeline
from tests.llm.test_near_copies import alike
from tests.llm.test_text_operators import SCHEMA, WORD, base, corpus, deduplicated, hits

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_stages(spark, tmp_path):
    rows = [r for r in corpus() if r[0] != 154]
    items = [(1, " ".join(rows[3][1].split()[:14])), (2, "never to be found")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    stage = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stage[name](spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == names[-1] or out.columns == docs.columns
        return out, [tuple(r) for r in out.collect()]

    docs, kept = run("quality_rules", docs)
    failed = {r[0] for r in rows for b in [base(r[1])] if b[0] < 10 or 100 * b[4] > 20 * b[0]}
    assert failed and {r[0] for r in kept} <= {r[0] for r in rows} - failed and len(kept) > 80

    docs, lined = run("line_dedup", docs)
    assert collections.Counter((i, t) for i, t, *_ in lined) == collections.Counter((i, t) for i, t, *_ in deduplicated(kept).elements())
    assert all(n == len(t) for _, t, _, _, n in lined)

    docs, single = run("simhash_near_dedup", docs)
    assert sorted(r[0] for r in single) == alike(lined)  # five-word shingles, similarity 0.8
    assert set(single) <= set(lined)

    docs, clean = run("benchmark_decontamination", docs)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, t.lower())
        for a in range(max(1, len(w) - 9)):
            windows[tuple(w[a : a + 10])].add(i)
    assert collections.Counter(clean) == collections.Counter(r for r in single if not hits(r[1], windows)[1])

    _, mixed = run("source_mixing", docs)
    copies = collections.Counter(r[:5] for r in mixed)
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    assert all(sorted(r[5] for r in mixed if r[0] == i[0]) == list(range(1, n + 1)) for i, n in copies.items())
    size = sum(len(re.findall(WORD, r[1] or "")) for r in clean)
    assert 0.8 * size < sum(len(re.findall(WORD, r[1] or "")) for r in mixed) <= 2 * size


def test_whole_run(spark, tmp_path):
    spark.createDataFrame(corpus(40), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy"] and out.count() > 10


def test_stages_take_nulls_ties_repeats_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(None, "x y"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, None, None, None), (1, None, None, None, None), (1, "", "en", "s", 0), (2, text, None, "s", 5), (2, text, None, "s", 5), (3, text + " more", "xx", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()]
        kept = {r[0] for r in out}
        if name == "quality_rules":
            assert kept == {None, 2, 3} and len(out) == 4
        elif name == "line_dedup":
            assert len(out) == 6
        elif name == "simhash_near_dedup":
            assert sorted(kept) == [1, 2] and len(out) == 2
        elif name == "benchmark_decontamination":
            assert len(out) == 6


def test_near_copies_by_fingerprint_go(spark, tmp_path):
    """Texts whose fingerprints differ in 3 bits or fewer are near copies whatever share of their shingles is equal, and groups join over both kinds."""
    import random

    from sparkloom.llm.near_copies import shingles
    from sparkloom.llm.simhash import fingerprint

    draw, found = random.Random(5), None
    block = " ".join(f"unit{i}" for i in range(12))
    while found is None:  # a repeated block outweighs single words in a fingerprint, but counts once in a set of shingles
        a, b = (" ".join([block] * 30 + [f"w{draw.randrange(10**6)}" for _ in range(12)]) for _ in range(2))
        if bin((fingerprint(a) ^ fingerprint(b)) & (2**64 - 1)).count("1") <= 3:
            found = a, b
    x, y = (set(shingles(t, 5).tolist()) for t in found)
    assert len(x & y) < 0.8 * len(x | y)
    docs = spark.createDataFrame([(2, found[0], "en", "s", 1), (1, found[1], "en", "s", 1), (3, found[0].replace("unit1 ", "UNIT1 "), "en", "s", 1), (4, "a quite different text of some words", "en", "s", 1)], SCHEMA)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()) == [1, 4]
