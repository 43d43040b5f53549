"""Verdicts per CSV file, and spanning files cut into stretches against Spark's reading of whole files."""

import random

import pytest

from patternflow import Rule, preview, read_csv, run_rule, run_rules, scratch_path, stage_table, with_row_numbers
from patternflow.model import PLACE
from patternflow.sources.csv_layout import inspect_csv, read_spanning
from patternflow.sources.readers import DifferentHeadersError, first_lines

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every 64 bytes, so that most stretches start in the middle of something; tasks stay apart."""
    tiny = {SPLIT: "64b", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in tiny}
    for k, v in tiny.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def cells(rnd):
    kind = rnd.randrange(7)
    word = "".join(rnd.choice("ab é😀.;-") for _ in range(rnd.randrange(0, 12)))
    quoted = word + rnd.choice(["\n", ",", '""', "\r\n", "\n\n", '"",""', "x"]) * rnd.randrange(1, 30)
    return [word, f'"{word}"', "", '""', f'"{quoted}"', f'"{quoted}\n"', '"\n"'][kind]


def table_text(rnd, rows, columns, ends):
    lines = [",".join(f"h{i}" for i in range(columns))]
    for _ in range(rows):
        lines.append(",".join(cells(rnd) for _ in range(rnd.choice([columns, columns, columns, columns - 1, columns + 1]))))
    return ends.join(lines) + ends * rnd.randrange(2)


def whole(spark, path):
    return [tuple(r) for r in spark.read.options(header=True, multiLine=True, escape='"').csv(path).collect()]


@pytest.mark.parametrize("seed", range(8))
def test_stretches_read_as_the_whole_file_does(spark, tmp_path, tiny_splits, seed):
    rnd = random.Random(seed)
    path = put(tmp_path, "t.csv", table_text(rnd, 40, 2 + seed % 3, "\r\n" if seed % 4 == 3 else "\n"))
    layout = inspect_csv(spark, path, cut_above=0)
    want = whole(spark, path)
    assert read_csv(spark, path, layout=layout).rdd.getNumPartitions() > 1
    dest = stage_table(read_csv(spark, path, layout=layout), scratch_path(spark, "staged"))
    got = with_row_numbers(spark, dest).orderBy("__rownum").drop("__rownum").collect()
    assert [tuple(r) for r in got] == want
    # Cells with bare carriage returns are the reader's own affair; none is generated here.
    assert len(layout.spanning) == 1 and not layout.whole


def test_a_cell_longer_than_many_stretches(spark, tmp_path, tiny_splits):
    text = 'a,b\n1,"' + "line, of \"\"text\"\"\n" * 60 + '"\n2,x\n3,"y\nz"\n'
    path = put(tmp_path, "t.csv", text)
    layout = inspect_csv(spark, path, cut_above=0)
    assert layout.spanning
    assert sorted(map(tuple, read_csv(spark, path, layout=layout).collect())) == sorted(whole(spark, path))


@pytest.mark.parametrize(
    "text",
    [
        'a,b\n5" pipe,x\n1,"y\nz"\n',
        'a,b\n"x"y,1\n2,"p\nq"\n',
        '"a\nb",c\n1,"x\ny"\n',
        'a,b\n1,"x\ry\nz"\n',
        'a,b\n1,"never closed\n2,x\n',
    ],
)
def test_what_counting_might_get_wrong_is_read_whole(spark, tmp_path, tiny_splits, text):
    path = put(tmp_path, "t.csv", text)
    layout = inspect_csv(spark, path, cut_above=0)
    got = sorted(map(tuple, read_csv(spark, path, layout=layout).collect()), key=str)
    assert got == sorted(whole(spark, path), key=str)
    if "never" not in text:
        assert layout.whole and not layout.spanning


def test_one_odd_file_leaves_the_others_split(spark, tmp_path):
    for i in range(6):
        put(tmp_path, f"part-0000{i}.csv", "a,b\n" + "".join(f"{i},{k}\n" for k in range(2000)))
    put(tmp_path, "part-00009.csv", 'a,b\n9,"x\ny"\n')
    old = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "4k")
    try:
        layout = inspect_csv(spark, str(tmp_path))
        assert [f.rsplit("/", 1)[1] for f in layout.odd] == ["part-00009.csv"]
        df = read_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 12
        dest = scratch_path(spark, "run")
        run_rule(spark, str(tmp_path), Rule.on("b", "y"), dest)
        numbered = with_row_numbers(spark, dest).orderBy("__rownum").collect()
    finally:
        spark.conf.set(SPLIT, old)
    assert [(r["a"], r["b"]) for r in numbered] == [(str(i), str(k)) for i in range(6) for k in range(2000)] + [("9", "x\ny")]
    assert [r["a"] for r in preview(df, 3).collect()] == ["0"] * 3


def test_layout_is_worked_out_once_for_several_reads(spark, tmp_path):
    put(tmp_path, "a.csv", 'a\n"x\ny"\n')
    layout = inspect_csv(spark, str(tmp_path))
    stats = run_rules(spark, str(tmp_path), {"r": Rule.on("a", "y")}, scratch_path(spark, "out"), layout=layout)
    assert stats["r"].matched_rows == 1


def test_names_that_occur_twice_in_every_file(spark, tmp_path):
    put(tmp_path, "1.csv", "a,A,b\n1,2,3\n")
    put(tmp_path, "2.csv", "a,A,b\n4,5,6\n")
    df = read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("1", "2", "3"), ("4", "5", "6")]
    put(tmp_path, "3.csv", "b,A,a\n7,8,9\n")
    with pytest.raises(DifferentHeadersError, match="different headers"):
        read_csv(spark, str(tmp_path))


def test_first_lines_are_found_without_sorting_the_others(spark, tmp_path, tiny_splits):
    from tests.conftest import plan

    put(tmp_path, "1.csv", "\ufeffa,A,b\n" + "1,2,3\n" * 2000)
    put(tmp_path, "2.csv", "a,A,b\n" + "0,0,0\n" * 2000)
    put(tmp_path, "3.csv", "")
    firsts = first_lines(spark, str(tmp_path))
    assert [r["head"] for r in firsts.collect()] == ["a,A,b"] * 2
    assert "Sort" not in plan(firsts)


def test_places_of_spanning_rows(spark, tmp_path, tiny_splits):
    path = put(tmp_path, "t.csv", 'a,b\n' + '"x\ny",1\n' * 30)
    layout = inspect_csv(spark, path, cut_above=0)
    schema = spark.read.option("header", True).csv(path).schema
    places = [r[0] for r in read_spanning(spark, layout, schema).select(PLACE).distinct().collect()]
    assert len(places) > 2 and all(p.startswith("file:") and len(p.split("\n")) == 2 for p in places)
