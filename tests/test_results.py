"""Row order without moving rows, results as versions, indexes bound to them, several rules in one read."""

import pytest
from pyspark.sql import functions as F

from patternflow import (
    FLAG,
    Predicate,
    Rule,
    apply_rule,
    export_csv,
    preview,
    read_csv,
    read_page,
    read_table,
    read_window,
    run_rule,
    run_rules,
    scratch_path,
    with_row_numbers,
    write_ordered,
    write_page_index,
)
from patternflow.model import PLACE, RuleError
from patternflow.operators import results
from patternflow.operators.paging import display, index_is_current
from patternflow.sources.order import in_source_order, with_places

N = 3000


@pytest.fixture(scope="module")
def uneven(spark):
    """Numbers in order over files of which the later ones are larger, so that tasks get them in another order."""
    path = scratch_path(spark, "uneven")
    df = spark.range(N).select(F.col("id").cast("string").alias("n"), F.repeat(F.lit("x"), (F.col("id") / 10).cast("int")).alias("t"))
    return write_ordered(df.withColumn("k", F.col("n").cast("int")), ["k"], path, 7)


def numbers(df):
    return [int(r["n"]) for r in df.orderBy("__rownum").collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_cost_no_exchange(spark, uneven):
    df = apply_rule(with_places(spark.read.parquet(uneven)), Rule.on("n", "1", "replace", "y"))
    assert PLACE in df.columns and "Exchange" not in plan(df) and "Sort" not in plan(df)


def test_runs_keep_the_order_of_several_files(spark, uneven):
    dest, again = scratch_path(spark, "run"), scratch_path(spark, "again")
    stats = run_rule(spark, uneven, Rule.on("n", "[02468]$", "keep"), dest, kind="parquet")
    even = list(range(0, N, 2))
    assert stats.columns == ["n", "t", "k"] and stats.output_rows == len(even)
    assert numbers(with_row_numbers(spark, dest)) == even
    assert numbers(with_row_numbers(spark, dest, files_fetched=2, files_per_broadcast=3)) == even
    got = [r["n"] for p in (1, 2, 3) for r in read_page(spark, dest, p, 400).rows.collect()]
    assert got == [str(x) for x in even[:1200]]
    assert PLACE not in read_page(spark, dest, 1).rows.columns + read_window(spark, dest).rows.columns
    # A run over that result, cut at row groups, and its export and preview.
    run_rule(spark, read_table(spark, dest).drop(FLAG), Rule.on("n", "0$", "drop"), again)
    left = [x for x in even if x % 10]
    assert numbers(with_row_numbers(spark, again)) == left
    out = scratch_path(spark, "csv")
    export_csv(read_table(spark, again), out)
    back = scratch_path(spark, "back")
    run_rule(spark, out, Rule.on("n", "1"), back)
    assert numbers(with_row_numbers(spark, back)) == left
    assert [r["n"] for r in preview(read_table(spark, again), 5).collect()] == [str(x) for x in left[:5]]
    assert [r["n"] for r in in_source_order(read_table(spark, again)).collect()] == [str(x) for x in left]


def test_matched_pages_follow_the_places(spark, uneven):
    dest = scratch_path(spark, "run")
    run_rule(spark, uneven, Rule.on("n", "7"), dest, kind="parquet", index_path=f"{dest}-index")
    want = [n for n in range(N) if "7" in str(n)]
    page = read_page(spark, dest, 3, 40, matched_only=True, index_path=f"{dest}-index")
    assert [int(r["n"]) for r in page.rows.collect()] == want[80:120]
    assert [r["__rownum"] for r in page.rows.collect()] == [n + 1 for n in want[80:120]]


def test_a_frame_that_moved_its_rows_has_no_places(spark, uneven):
    moved = spark.read.parquet(uneven).repartition(3)
    assert with_places(moved) is moved


def raw_parts(path):
    return sorted(p.name for p in path.glob("part-*"))


def test_a_swap_cut_short_anywhere_leaves_one_version(spark, tmp_path, monkeypatch):
    dest = tmp_path / "out"
    one = spark.range(10).withColumn("v", F.lit(1))
    two = spark.range(20).withColumn("v", F.lit(2))
    one.write.parquet(str(dest))

    class Killed(Exception):
        pass

    def killed(*_):
        raise Killed

    def held():
        return sorted({r["v"] for r in results.open_result(spark, str(dest)).collect()}), results.open_result(spark, str(dest)).count()

    with monkeypatch.context() as m:  # after the files, before their marker
        m.setattr(results, "finish_version", killed)
        with pytest.raises(Killed):
            results.write_version(two, str(dest))
    assert held() == ([1], 10)
    mark = results._mark
    with monkeypatch.context() as m:  # after the marker, before the old files go
        m.setattr(results, "_mark", lambda *a: (mark(*a), killed())[0] if a[2] else mark(*a))
        with pytest.raises(Killed):
            results.write_version(two, str(dest))
    assert held() == ([2], 20)
    results.write_version(one, str(dest))
    assert held() == ([1], 10) and spark.read.parquet(str(dest)).count() == 10
    assert len({n.split("-c0")[0][11:] for n in raw_parts(dest)}) == 1


def test_something_else_in_the_place_is_replaced(spark, tmp_path):
    dest = str(tmp_path / "out")
    for _ in range(2):
        spark.range(5).write.mode("append").parquet(dest)
    results.write_version(spark.range(3), dest)
    assert results.open_result(spark, dest).count() == 3
    results.write_version(spark.range(4), dest)
    assert results.open_result(spark, dest).count() == 4


@pytest.mark.parametrize("ordered", [False, True])
def test_an_index_of_a_replaced_table_is_not_used(spark, tmp_path, ordered):
    dest, index = str(tmp_path / "out"), str(tmp_path / "index")

    def write(n):
        df = spark.range(n).select(F.col("id").cast("string").alias("a"))
        if ordered:
            write_ordered(df.withColumn(FLAG, F.lit(True)), ["a"], dest, 3)
        else:
            run_rule(spark, df, Rule.on("a", "."), dest)

    write(200)
    write_page_index(spark, dest, index)
    assert index_is_current(spark, dest, index)
    write(120)
    assert not index_is_current(spark, dest, index)
    page = read_page(spark, dest, 2, 100, index_path=index)
    assert (page.total, page.rows.count()) == (120, 20)
    assert read_window(spark, dest, 100, 50, index_path=index).rows.count() == 20
    write_page_index(spark, dest, index)
    assert index_is_current(spark, dest, index)


RULES = {
    "find": Rule.on("n", "1"),
    "keep it": Rule.on("n", "^2", "keep"),
    "drop/it": Rule.on("n", "3$", "drop"),
    "edit": Rule((Predicate("n", "5"), Predicate("t", "xx")), "any", "replace", "#"),
    "extract": Rule((Predicate("n", r"\d\d"), Predicate("n", r"\d")), "all", "extract"),
    "nothing": Rule.on("n", "no such", "keep"),
}


def rows(df):
    return sorted(map(str, display(df, "none").collect()))


@pytest.mark.parametrize("typed", [False, True])
def test_rules_at_once_are_the_single_runs(spark, uneven, typed):
    rules = RULES | ({"typed": Rule.on("k", "4", "mask")} if typed else {})
    dest, runs = scratch_path(spark, "many"), scratch_path(spark, "runs")
    source = spark.read.parquet(uneven)
    found = run_rules(spark, source, rules, dest, runs_path=runs, run_id="r")
    assert list(found) == list(rules)
    for name, rule in rules.items():
        single = run_rule(spark, source, rule, scratch_path(spark, "one"))
        both = found[name]
        assert (both.total_rows, both.matched_rows, both.output_rows) == (single.total_rows, single.matched_rows, single.output_rows)
        a, b = read_table(spark, both.result_path), read_table(spark, single.result_path)
        assert a.schema == b.schema and both.columns == single.columns
        assert rows(a) == rows(b)
        x, y = (with_row_numbers(spark, p).orderBy("__rownum").collect() for p in (both.result_path, single.result_path))
        assert x == y
    record = spark.read.parquet(runs)
    assert record.filter("status = 'SUCCESS'").count() == len(rules)
    # Once more over what is there.
    again = run_rules(spark, source, {"find": RULES["find"]}, dest)
    assert read_table(spark, again["find"].result_path).count() == N


def test_rules_at_once_read_the_source_once(spark, uneven):
    from patternflow.operators.rules import apply_rules_at_once

    df = with_places(spark.read.parquet(uneven))
    shown = plan(apply_rules_at_once(df, RULES))
    assert shown.count("FileScan") == 1 and "Exchange" not in shown and "Sort" not in shown


def test_several_rules_read_a_csv_source_once(spark, uneven, monkeypatch):
    from patternflow.plans import runs

    out, opened = scratch_path(spark, "csv"), []
    export_csv(spark.read.parquet(uneven), out)
    monkeypatch.setattr(runs, "read_table", lambda *a, **b: opened.append(1) or read_csv(spark, out))
    stats = run_rules(spark, out, dict(list(RULES.items())[:5]), scratch_path(spark, "many"))
    assert len(opened) == 1 and all(s.total_rows == N for s in stats.values())


def test_a_rule_that_cannot_run_stops_all_before_reading(spark, uneven):
    runs, dest = scratch_path(spark, "runs"), scratch_path(spark, "many")
    source = spark.read.parquet(uneven)
    for bad in (Rule.on("absent", "x"), Rule.on("n", "(a+)+")):
        with pytest.raises(RuleError):
            run_rules(spark, source, {"good": RULES["find"], "bad": bad}, dest, runs_path=runs, run_id="r")
    record = spark.read.parquet(runs).collect()
    assert {(r["run_id"], r["status"]) for r in record} == {("r/bad", "FAILURE")}
    with pytest.raises(RuleError, match="name"):
        run_rules(spark, source, {"": RULES["find"]}, dest)
