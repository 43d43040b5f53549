import threading
import time

import pytest
from pyspark.sql import functions as F

from patternflow import (
    FLAG,
    Predicate,
    Rule,
    StreamCounts,
    apply_rule,
    apply_rule_stream,
    entity_rule,
    read_drops,
    read_table,
    run_history,
    run_request,
    run_rule,
    run_rules,
    scratch_path,
)
from patternflow.operators.lookup import attach
from patternflow.plans.requests import context_signature, create_store, request_key, resolve_with_reuse
from patternflow.plans.runs import UnsafePatternError, cancel_run, run_progress


@pytest.fixture(scope="module")
def people_csv(spark):
    path = scratch_path(spark, "people")
    data = [(str(i), f"n{i}", f"u{i}@x.com" if i % 3 else None) for i in range(10)]
    df = spark.createDataFrame(data, "ID string, Name string, Email string").coalesce(1)
    df.write.option("header", True).csv(path)
    return path


def test_run_writes_counts_and_records(spark, people_csv):
    runs, dest = scratch_path(spark, "runs"), scratch_path(spark, "out")
    rule = entity_rule("email", ["Email"], "keep")
    stats = run_rule(spark, people_csv, rule, dest, runs_path=runs, request="keep emails")
    assert (stats.total_rows, stats.matched_rows, stats.output_rows) == (10, 6, 6)
    assert stats.columns == ["ID", "Name", "Email"]
    assert spark.read.parquet(dest).columns == ["ID", "Name", "Email", FLAG]
    assert spark.read.parquet(dest).count() == 6
    record = spark.read.parquet(runs).first()
    assert (record["status"], record["action"], record["matched_rows"]) == ("SUCCESS", "keep", 6)
    assert record["predicates"][0]["column"] == "Email"


def test_failed_run_is_recorded(spark, people_csv):
    runs = scratch_path(spark, "runs")
    with pytest.raises(UnsafePatternError):
        run_rule(spark, people_csv, Rule.on("Name", "(a+)+"), scratch_path(spark, "o"), runs_path=runs)
    with pytest.raises(Exception, match="Columns not in the table: Nope"):
        run_rule(spark, people_csv, Rule.on("Nope", "a"), scratch_path(spark, "o"), runs_path=runs)
    history = run_history(spark.read.parquet(runs), people_csv).collect()
    assert [r["status"] for r in history] == ["FAILURE", "FAILURE"]
    assert "Nope" in history[0]["error"]


def test_runs_do_not_chain(spark, people_csv):
    rules = {"a": Rule.on("Name", "n", "replace", "m"), "b": Rule.on("Name", "n", "mask", "#")}
    stats = run_rules(spark, people_csv, rules, scratch_path(spark, "out"))
    assert spark.read.parquet(stats["b"].result_path).first()["Name"] == "#0"
    assert stats["a"].matched_rows == stats["b"].matched_rows == 10


def test_history_pages(spark):
    runs = spark.range(120).select(
        F.col("id").cast("string").alias("run_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"),
        F.timestamp_seconds("id").alias("created_at"),
    )
    ids = [int(r["run_id"]) for r in run_history(runs, "a", page=2).collect()]
    assert ids == list(range(18, -1, -2))
    assert run_history(runs, page_size=9999).count() == 120


def test_cancel(spark):
    slow = spark.range(0, 4_000_000_000, 1, 8).select(F.col("id").cast("string").alias("t"))
    failed, runs = [], scratch_path(spark, "runs")

    def go():
        try:
            run_rule(spark, slow, Rule.on("t", "x+y"), scratch_path(spark, "o"), run_id="stop-me", runs_path=runs)
        except Exception as exc:
            failed.append(exc)

    t = threading.Thread(target=go)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        if spark.sparkContext.statusTracker().getJobIdsForGroup("stop-me"):
            break
    time.sleep(0.5)
    assert 0.0 <= run_progress(spark, "stop-me") < 1.0
    cancel_run(spark, "stop-me")
    t.join(60)
    assert failed and spark.read.parquet(runs).first()["status"] == "FAILURE"


def test_stream_equals_batch(spark):
    drop, dest, check = (scratch_path(spark, x) for x in ("drop", "out", "check"))
    data = [(str(i), None if i % 5 == 0 else f"a{i}\nb") for i in range(50)]
    df = spark.createDataFrame(data, "id string, note string")
    df.repartition(4).write.options(header=True, escape='"').csv(drop)
    rule = Rule((Predicate("note", r"\d"), Predicate("id", "0$")), "any", "mask", "#")
    counts = StreamCounts()
    spark.streams.addListener(counts)
    try:
        stream = read_drops(spark, drop, ["id", "note"], files_per_batch=1)
        apply_rule_stream(stream, rule, dest, check).awaitTermination()
        want = sorted(map(str, apply_rule(df, rule).collect()))
        assert sorted(map(str, spark.read.parquet(dest).collect())) == want
        # A second drain picks up new files only.
        df.limit(3).coalesce(1).write.mode("append").options(header=True, escape='"').csv(drop)
        apply_rule_stream(stream, rule, dest, check).awaitTermination()
        assert spark.read.parquet(dest).count() == 53
        for _ in range(50):
            if counts.total_rows == 53:
                break
            time.sleep(0.1)
        assert counts.total_rows == 53
    finally:
        spark.streams.removeListener(counts)


# ---- keys and reuse ----------------------------------------------------------


def key(spark, prompt, columns=None, samples=None, action=None, model="m"):
    arr = lambda xs: F.array(*map(F.lit, xs))
    context = context_signature(
        arr(columns) if columns else None,
        F.create_map(*(x for k, v in samples.items() for x in (F.lit(k), arr(v)))) if samples else None,
        F.lit(action) if action else None,
    )
    return spark.range(1).select(request_key(F.lit(prompt), model, context)).first()[0]


def test_request_keys(spark):
    base = key(spark, "Remove  False\n", ["A"], {"A": ["False"]})
    assert base == key(spark, " remove false", ["A"], {"A": ["False"]})
    assert base != key(spark, "remove false", ["A"], {"A": ["FALSE"]})
    assert base != key(spark, "remove false", ["A"], {"A": ["False"]}, "mask")
    assert base != key(spark, "remove false", ["A"], {"A": ["False"]}, model="other")
    assert key(spark, "x", ["A", "B"]) != key(spark, "x", ["B", "A"])
    two = {"A": ["1"], "B": ["2"]}
    assert key(spark, "x", ["A"], two) == key(spark, "x", ["A"], dict(reversed(two.items())))


def test_reuse_within_its_lifetime(spark):
    store = create_store(spark, scratch_path(spark, "store"))
    asked = spark.createDataFrame(
        [(1, "find emails", ["a"]), (2, "FIND  emails", ["a"]), (3, "find emails", ["b"]), (4, "zzz", ["a"])],
        "id int, prompt string, columns array<string>",
    )
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d}"))

    def sources(now):
        out = resolve_with_reuse(spark, asked, store, now=now).orderBy("id").collect()
        assert [p["column"] for p in out[2]["predicates"]] == ["b"]
        assert out[3]["error"] and out[3]["predicates"] is None
        return [r["source"] for r in out]

    assert sources(day(1)) == ["heuristic"] * 4
    assert spark.read.parquet(store).count() == 2
    assert sources(day(20)) == ["cache", "cache", "cache", "heuristic"]
    assert spark.read.parquet(store).count() == 2
    later = F.to_timestamp(F.lit("2024-02-15"))
    assert sources(later) == ["heuristic"] * 4


def test_hot_keys_take_the_broadcast_side(spark):
    left = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key")
    )
    left = left.unionByName(spark.createDataFrame([(-1, None)], "id long, key string"))
    right = left.select("key").distinct().filter("key is not null and key <> '7'").withColumn("v", F.concat("key", F.lit("!")))
    got = attach(left, right, "key", hot_min_rows=500)
    want = left.join(right, "key", "left")
    assert got.count() == 6001
    assert got.select("id", "v").exceptAll(want.select("id", "v")).count() == 0


def test_request_to_result(spark, people_csv):
    from patternflow import run_request

    dest = scratch_path(spark, "out")
    stats = run_request(spark, people_csv, "redact the email addresses", ["Email"], dest)
    assert (stats.matched_rows, stats.output_rows) == (6, 10)
    assert {r["Email"] for r in spark.read.parquet(dest).collect()} == {None, "••••"}


def test_dataset_catalogue(spark, people_csv):
    from patternflow import register_dataset
    from patternflow.plans.datasets import dataset

    catalog = scratch_path(spark, "datasets")
    first = register_dataset(spark, people_csv, catalog, kind="csv")
    register_dataset(spark, people_csv, catalog, kind="csv")
    record = dataset(spark, catalog, first).first()
    assert record["columns"] == ["ID", "Name", "Email"] and record["size_bytes"] > 100
    assert spark.read.parquet(catalog).count() == 2


def test_failed_run_leaves_the_old_result(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("a"))
    dest = str(tmp_path / "out")
    run_rule(spark, df, Rule.on("a", "1"), dest)
    broken = df.select(F.when(F.col("a") == "150", F.raise_error(F.lit("no"))).otherwise(F.col("a")).alias("a"))
    with pytest.raises(Exception, match="no"):
        run_rule(spark, broken, Rule.on("a", "2"), dest)
    assert spark.read.parquet(dest).count() == 200
    with pytest.raises(Exception, match="Invalid"):
        run_rule(spark, df, Rule.on("a", "(?P<n>a)"), dest)
    assert spark.read.parquet(dest).count() == 200
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_run_result_folder_is_read_as_parquet(spark, tmp_path):
    dest = str(tmp_path / "out")
    run_rule(spark, spark.createDataFrame([("x",)], "a string"), Rule.on("a", "x"), dest)
    assert read_table(spark, dest).columns == ["a", "__matched__"]


def test_answers_alive_at_the_call_stay(spark, tmp_path):
    """An entry that expires between the call and the action still answers, all of it."""
    import time

    from patternflow.plans.requests import STORE_SCHEMA, TTL_DAYS, create_store, resolve_with_reuse, with_keys

    store = create_store(spark, str(tmp_path / "store"))
    asked = spark.createDataFrame([("find emails", ["a"])], "prompt string, columns array<string>")
    first = resolve_with_reuse(spark, asked, store).first()
    assert first["source"] != "cache"
    old = spark.read.schema(STORE_SCHEMA).parquet(store).withColumn(
        "created_at", F.current_timestamp() - F.make_dt_interval(F.lit(TTL_DAYS)) + F.expr("INTERVAL 6 SECONDS")
    )
    late = str(tmp_path / "late")
    old.write.parquet(late)
    out = resolve_with_reuse(spark, asked, late)
    time.sleep(7)
    got = out.first()
    assert got["source"] == "cache" and got["predicates"] == first["predicates"]
    assert with_keys(asked).first()["key"] == got["key"]


def test_requests_of_runs_go_through_the_store(spark, tmp_path):
    store = create_store(spark, str(tmp_path / "store"))
    source = spark.createDataFrame([("x@y.com",), ("none",)], "a string")
    for dest in ("one", "two"):
        stats = run_request(spark, source, "replace emails with 'E'", ["a"], str(tmp_path / dest), store=store)
        assert stats.matched_rows == 1
    assert spark.read.parquet(store).count() == 1
    plain = run_request(spark, source, "replace emails with 'E'", ["a"], str(tmp_path / "three"))
    rows = [spark.read.parquet(str(tmp_path / d)).orderBy("a").collect() for d in ("one", "two", "three")]
    assert rows[0] == rows[1] == rows[2] and plain.matched_rows == 1


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    from patternflow.plans import requests as R

    store = create_store(spark, str(tmp_path / "store"))
    asked = spark.createDataFrame([(f"find emails {i}", ["a"]) for i in range(300)], "prompt string, columns array<string>")
    resolve_with_reuse(spark, asked, store).collect()
    assert len(list((tmp_path / "store").glob("bucket=*"))) > 100
    one = R.with_keys(asked.limit(1))
    entries = R._entries(spark, store, one)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and entries.count() < 20
    assert {r["source"] for r in resolve_with_reuse(spark, asked, store).collect()} == {"cache"}


def test_requests_are_read_once(spark, tmp_path):
    path, read = str(tmp_path / "asked"), spark.sparkContext.accumulator(0)
    asked = spark.createDataFrame([(i, "find emails", ["a"]) for i in range(50)], "id int, prompt string, columns array<string>")
    asked.write.parquet(path)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = spark.read.parquet(path).mapInArrow(count, asked.schema)
    out = resolve_with_reuse(spark, counted, create_store(spark, str(tmp_path / "store")))
    assert out.count() == 50 and out.filter("source = 'heuristic'").count() == 50
    assert read.value == 50


def test_compaction_keeps_the_newest_live_entries(spark, tmp_path):
    from patternflow.plans.requests import STORE_SCHEMA, compact_store

    day = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d}"))
    rows = [("aa1", "old", 1), ("aa1", "new", 9), ("bb2", "gone", 2), ("bb3", "kept", 8)]
    flat = spark.createDataFrame(rows, "key string, explanation string, d int").selectExpr(
        "key", "cast(null as array<struct<column:string,pattern:string,explanation:string>>) predicates", "'all' combinator",
        "explanation", "'find' action", "'' value", "make_timestamp(2024, 1, d, 0, 0, 0) created_at",
    )
    flat.write.parquet(str(tmp_path / "flat"))
    dest = compact_store(spark, str(tmp_path / "flat"), str(tmp_path / "new"), now=day(12), ttl_days=5)
    again = compact_store(spark, dest, str(tmp_path / "again"), now=day(12), ttl_days=5)
    for store in (dest, again):
        left = spark.read.schema(STORE_SCHEMA).parquet(store).select("key", "explanation").collect()
        assert sorted(map(tuple, left)) == [("aa1", "new"), ("bb3", "kept")]
    assert len(list((tmp_path / "new").glob("bucket=*/*.parquet"))) == 2


@pytest.fixture
def drops(spark, tmp_path):
    """Files of which one has cells that span lines."""
    folder = tmp_path / "drop"
    folder.mkdir()
    for i in range(5):
        body = "".join(f"{i}{k},n{k}\n" for k in range(20))
        (folder / f"{i}.csv").write_text("id,note\n" + (body if i != 3 else '3,"n1\nn2"\n'))
    return folder


def run_drops(spark, tmp_path, drops, **options):
    from patternflow.streaming.filedrop import run_rule_drops

    rule = Rule.on("note", "n1", "replace", "#")
    places = (str(tmp_path / x) for x in ("out", "check", "runs"))
    return run_rule_drops(spark, str(drops), ["id", "note"], rule, *places, stream_id="s", files_per_batch=2, **options)


def test_a_record_for_each_batch_of_files(spark, tmp_path, drops):
    from patternflow.streaming.filedrop import BATCH, dropped_results

    run_drops(spark, tmp_path, drops).awaitTermination()
    record = spark.read.parquet(str(tmp_path / "runs")).orderBy("run_id").collect()
    assert [(r["run_id"], r["request"], r["status"]) for r in record] == [(f"s/{i}", f"{n} files", "SUCCESS") for i, n in enumerate((2, 2, 1))]
    assert sum(r["total_rows"] for r in record) == 81 and sum(r["matched_rows"] for r in record) == 4 * 11 + 1
    got = dropped_results(spark, str(tmp_path / "out"))
    assert got.count() == 81 and got.select(BATCH).distinct().count() == 3
    assert got.filter("id = '3'").first()["note"] == "#\nn2"
    # What arrives later is a batch of its own.
    (drops / "9.csv").write_text("id,note\nx,y\n")
    run_drops(spark, tmp_path, drops).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4


@pytest.mark.parametrize("when", ["before the record", "after the record"])
def test_a_batch_cut_short_leaves_one_record(spark, tmp_path, drops, monkeypatch, when):
    from patternflow.plans import runs
    from patternflow.streaming.filedrop import dropped_results

    real = runs.record_runs

    def cut_short(*args):
        if when == "after the record":
            real(*args)
        raise RuntimeError("cut short")

    with monkeypatch.context() as m:
        m.setattr(runs, "record_runs", cut_short)
        with pytest.raises(Exception, match="cut short"):
            run_drops(spark, tmp_path, drops).awaitTermination()
    run_drops(spark, tmp_path, drops).awaitTermination()
    record = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(r["run_id"] for r in record.collect()) == ["s/0", "s/1", "s/2"]
    assert dropped_results(spark, str(tmp_path / "out")).count() == 81


def test_a_batch_with_another_header_stops(spark, tmp_path, drops):
    (drops / "a.csv").write_text("note,id\nx,y\n")
    with pytest.raises(Exception):
        run_drops(spark, tmp_path, drops).awaitTermination()
