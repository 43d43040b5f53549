import random

import pytest
from pyspark.sql import functions as F

from patternflow import (
    FLAG,
    page_count,
    read_page,
    read_window,
    result_totals,
    scratch_path,
    with_row_numbers,
    write_ordered,
    write_page_index,
)
from patternflow.operators.numbering import file_order
from patternflow.operators.paging import jump_target
from tests.conftest import plan


def shown(page):
    return [(r["name"], r["__matched__"], r["__rownum"]) for r in page.rows.collect()]


@pytest.fixture(scope="module")
def five(spark):
    path = scratch_path(spark, "five")
    data = [(f"r{i}", i in (2, 4)) for i in range(1, 6)]
    spark.createDataFrame(data, f"name string, {FLAG} boolean").coalesce(1).write.parquet(path)
    return path


def test_first_page(spark, five):
    page = read_page(spark, five, 1, 2)
    assert [n for *_, n in shown(page)] == [1, 2]
    assert (page.total, page.num_pages, page.columns) == (5, 3, ["name"])


def test_second_page(spark, five):
    assert [n for *_, n in shown(read_page(spark, five, 2, 2))] == [3, 4]


def test_matched_only_keeps_full_numbers(spark, five):
    page = read_page(spark, five, 1, 10, matched_only=True)
    assert shown(page) == [("r2", True, 2), ("r4", True, 4)]
    assert (page.total, page.total_all, page.matched_only) == (2, 5, True)


def test_flags_and_size_limits(spark, five):
    page = read_page(spark, five, 0, 10_000)
    assert [m for _, m, _ in shown(page)] == [False, True, False, True, False]
    assert (page.page, page.page_size) == (1, 500)


def test_past_the_end(spark, five):
    assert shown(read_page(spark, five, 9, 2)) == []
    assert shown(read_page(spark, five, 9, 2, matched_only=True)) == []


def test_table_without_flag(spark):
    path = scratch_path(spark, "plain")
    spark.range(5).select(F.col("id").cast("string").alias("name")).coalesce(1).write.parquet(path)
    page = read_page(spark, path, 1, 3, matched_only=True)
    assert not page.matched_only and page.matched_total == 0
    assert shown(page) == [("0", False, 1), ("1", False, 2), ("2", False, 3)]
    assert tuple(result_totals(spark.read.parquet(path)).first()) == (5, 0)


def test_windows_follow_the_cursor(spark):
    path = scratch_path(spark, "nums")
    rows = [(str(i), f"v{i}" if i != 3 else None) for i in range(1, 6)]
    spark.createDataFrame(rows, "ID string, Val string").coalesce(1).write.parquet(path)
    seen, cursor = [], None
    while True:
        window = read_window(spark, path, cursor, 2)
        seen.append([(r["ID"], r["Val"]) for r in window.rows.collect()])
        if window.eof:
            break
        cursor = window.cursor
    assert seen == [[("1", "v1"), ("2", "v2")], [("3", ""), ("4", "v4")], [("5", "v5")]]
    with pytest.raises(ValueError):
        read_window(spark, path, "nonsense")


def test_all_pages_against_brute_force(spark):
    """Uneven files, one with a third of the rows and one empty."""
    rng = random.Random(1)
    n = 240
    flags = [rng.random() < 0.3 for _ in range(n)]
    part = lambda i: 0 if i < 10 else 1 if i < 90 else 3 if i < 200 else 4
    data = [(f"r{i}", flags[i], i, part(i)) for i in range(n)]
    df = spark.createDataFrame(data, f"name string, {FLAG} boolean, i int, p int")
    path = scratch_path(spark, "pages")
    for p in range(5):
        one = df.filter(F.col("p") == p).coalesce(1).sortWithinPartitions("i")
        one.drop("p").write.mode("append").parquet(f"{path}/p={p}")
    index = write_page_index(spark, path, scratch_path(spark, "index"))
    for size in (7, 50):
        for page in (1, 2, 5, 30):
            got = shown(read_page(spark, path, page, size, index_path=index))
            lo = (page - 1) * size
            assert got == [(f"r{i}", flags[i], i + 1) for i in range(n)][lo : lo + size]
            got = shown(read_page(spark, path, page, size, matched_only=True, index_path=index))
            assert got == [(f"r{i}", True, i + 1) for i in range(n) if flags[i]][lo : lo + size]
    for k in (1, 2, 100):
        numbered = with_row_numbers(spark, path, files_per_broadcast=k)
        assert numbered.filter(F.col("__rownum") != F.col("i") + 1).count() == 0
        assert numbered.count() == n


def test_page_reads_only_its_files(spark):
    path = scratch_path(spark, "many")
    write_ordered(spark.range(1000).withColumn(FLAG, F.lit(True)), ["id"], path, 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        page = read_page(spark, path, 1, 20)
        assert len(page.rows.collect()) == 20
        scan = page.rows._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numFiles").value() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbering_moves_no_rows(spark, sf_dir):
    text = plan(with_row_numbers(spark, f"{sf_dir}/documents.parquet"))
    rows_side = text.split("BroadcastExchange")[0]
    assert "Exchange" not in rows_side and "Sort" not in rows_side


def test_long_runs_of_one_key_are_cut(spark):
    path = scratch_path(spark, "skew")
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")))
    write_ordered(df, ["k"], path, 6)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 900
    numbered = with_row_numbers(spark, path).orderBy("__rownum").collect()
    assert [(r["k"], r["id"]) for r in numbered] == sorted((r["k"], r["id"]) for r in numbered)


def test_file_order_past_five_digits(spark):
    names = [f"file:/t/part-{i:05d}-u.c000.snappy.parquet" for i in (7, 99_999, 100_000, 100_001)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "p string")
    assert [r["p"] for r in df.orderBy(file_order(F.col("p"))).collect()] == names


def test_arithmetic():
    assert [page_count(t, 50) for t in (0, 1, 50, 51)] == [1, 1, 1, 2]
    assert jump_target(137, 1000) == (137, 2, 36)
    assert jump_target(5000, 250) == (250, 3, 49)
    assert jump_target(-3, 250) == (1, 1, 0)


def test_a_large_input_is_written_in_more_ranges(spark, monkeypatch):
    """So that no task's share grows with the input; a small one gets as many as were asked for."""
    from patternflow.operators import numbering

    source = scratch_path(spark, "source")
    spark.range(3000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(3).write.parquet(source)
    for most, files in ((1 << 26, 2), (1 << 13, 24)):
        monkeypatch.setattr(numbering, "RANGE_BYTES", most)
        path = write_ordered(spark.read.parquet(source), ["id"], scratch_path(spark, "ranges"), 2)
        written = len(spark.read.parquet(path).inputFiles())
        assert written == files if files == 2 else written >= files
        assert [r["id"] for r in read_window(spark, path, 1500, 3).rows.collect()] == ["1500", "1501", "1502"]
