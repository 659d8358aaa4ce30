"""CSV files in many blocks against Python's reader, headers by name, malformed rows, and outputs that appear only when verified."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import csv_blocks, tables


@pytest.fixture
def blocks(spark):
    """Files are cut into blocks of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def cut(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_line_ends_inside_as_the_reader_says():
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choices('",ab ', k=rng.randint(0, 9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\nz"
            rows = list(csv.reader(io.StringIO(text, newline="")))
            if line or inside:
                assert csv_blocks.ends_inside(line, inside) == (len(rows) == 1), (line, inside)


@pytest.mark.parametrize("size", [150, 5000])
def test_blocks_equal_the_reader(spark, tmp_path, blocks, size):
    blocks(size)
    rng = random.Random(size)
    (tmp_path / "in").mkdir()
    want = []
    for name in ("a.csv", "b.csv"):
        text = "id,name,note\n"
        for i in range(60):
            cell = lambda: rng.choice(["", "x", 'in 5" pipe', '"q, r"', '"two\nlines"', '"a ""b"" c"', "é", '"tail"x', '"' + "long\n" * rng.randint(1, 40) + '"', '""'])
            text += f"{i},{cell()},{cell()}" + rng.choice(["\n", "\r\n", "\n\n"])
        (tmp_path / "in" / name).write_bytes(text.encode())
        want += [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    found = csv_blocks.records(spark, str(tmp_path / "in"))
    assert sorted(r["fields"] for r in found.collect()) == sorted(want)
    if size < 5000:
        assert csv_blocks._lines(spark, str(tmp_path / "in")).select("file", "block").distinct().count() > 5
    out = tables.read_csv(spark, str(tmp_path / "in"), "note string, id int")
    assert sorted((r["id"], r["note"] or "") for r in out.collect()) == sorted((int(r[0]), r[2]) for r in want if r[0] != "id")


def test_headers_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n")
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int").first().asDict() == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="no header a,c"):
        tables.read_csv(spark, str(tmp_path / "x.csv"), "a int, c int")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        tables.read_csv(spark, str(tmp_path / "empty.csv"), "a int")
    (tmp_path / "head.csv").write_text("﻿a,b\n", encoding="utf-8")
    assert tables.read_csv(spark, str(tmp_path / "head.csv"), "a int, b int").count() == 0


@pytest.mark.parametrize("row", ["zz,3", "4", "1,2,3"])
def test_malformed_rows_fail(spark, tmp_path, row):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "m.csv").write_text(f"a,b\n1,2\n{row}\n")
    with pytest.raises(Exception, match="malformed row"):
        tables.read_found(spark, str(tmp_path), "m.csv", "a int, b int").collect()


def test_a_field_that_is_never_closed_fails(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,"x\n2,3\n')
    with pytest.raises(Exception, match="not closed"):
        tables.read_csv(spark, str(tmp_path / "o.csv"), "a int, b string").collect()


def test_outputs_appear_only_when_verified(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    tables.write_verified({one: spark.range(3)}, lambda t: None)

    def check(written):
        assert {p: t.count() for p, t in written.items()} == {one: 5, two: 2}
        if bad:
            raise ValueError("wrong")

    bad = True
    with pytest.raises(ValueError, match="wrong"):
        tables.write_verified({one: spark.range(5), two: spark.range(2)}, check)
    assert spark.read.parquet(one).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["one"]
    with pytest.raises(Exception, match="boom"):
        tables.write_verified({one: spark.range(5).where(F.raise_error(F.lit("boom")).cast("boolean"))}, check)
    assert spark.read.parquet(one).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["one"]
    bad = False
    tables.write_verified({one: spark.range(5), two: spark.range(2)}, check)
    assert spark.read.parquet(one).count() == 5 and spark.read.parquet(two).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]
