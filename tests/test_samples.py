import random

import pytest
from pyspark.sql import functions as F

from patternflow import (
    MissingColumnsError,
    column_kinds,
    sample_table,
    sample_values,
    samples_map,
    scratch_path,
    table_kinds,
    with_row_numbers,
    write_ordered,
    write_page_index,
)


def numbered(spark, values, columns=("c",)):
    data = [(*(v if isinstance(v, tuple) else (v,)), i + 1) for i, v in enumerate(values)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns) + ", __rownum long")


def samples(df, columns, k, n):
    row = samples_map(sample_values(df, columns, k, n)).first()
    return dict(row["samples"] or {})


def brute(values, k, max_len):
    stride = max(1, len(values) // k)
    seen = []
    for start in range(stride):
        for i in range(start, len(values), stride):
            v = (values[i] or "").strip()[:max_len]
            if v and v not in seen and len(seen) < k:
                seen.append(v)
    return seen


@pytest.mark.parametrize(
    "values, k, n, want",
    [
        (["False", "True", "False"], 8, 80, ["False", "True"]),
        (["a", "b", "c", "d", "e"], 3, 80, ["a", "b", "c"]),
        (["x" * 100], 8, 5, ["xxxxx"]),
        ([f"v{i}" for i in range(20)], 10, 80, [f"v{i}" for i in range(0, 20, 2)]),
        (["a"], 0, 80, None),
    ],
)
def test_fixed_cases(spark, values, k, n, want):
    got = samples(numbered(spark, values), ["c"], k, n)
    assert got == ({"c": want} if want else {})


def test_columns_without_values_are_absent(spark):
    df = numbered(spark, [("", "keep"), ("   ", None), (" ", None)], ("A", "B"))
    assert samples(df, ["A", "B"], 8, 80) == {"B": ["keep"]}
    with pytest.raises(MissingColumnsError):
        sample_values(df, ["Absent"])


def test_against_brute_force(spark):
    """Columns the early laps fill, columns they leave short, and one nearly all one value."""
    rng = random.Random(5)
    n = 900
    many = [f"m{rng.randint(0, 400)}" for _ in range(n)]
    few = [rng.choice(["x", " x ", "y"]) for _ in range(n)]
    rare = [f"r{i}" if i % 97 == 13 else None for i in range(n)]
    hot = ["same" if i % 3 else f"h{i // 60}" for i in range(n)]
    df = numbered(spark, list(zip(many, few, rare, hot)), ("many", "few", "rare", "hot")).repartition(5)
    for k in (3, 10):
        got = samples(df, ["many", "few", "rare", "hot"], k, 80)
        assert got == {
            "many": brute(many, k, 80), "few": brute(few, k, 80),
            "rare": brute(rare, k, 80), "hot": brute(hot, k, 80),
        }


def test_kinds(spark):
    columns = {
        "Email": ("x", "Email"), "work_link": ("x", "URL"), "site": ("https://a.b", "URL"), "w": ("WWW.a.b", "URL"),
        "update": ("x", "Date / time"), "made_at": ("x", "Date / time"), "d": ("2024-1-02 x", "Date / time"),
        "ID": ("x", "Identifier / number"), "user_id": ("x", "Identifier / number"), "Phone": ("x", "Identifier / number"),
        "n": (" $1,200.50% ", "Number"), "mail": ("a@b.c", "Email"), "t": ("hello", "Text"), "none": (None, "Text"),
    }
    df = numbered(spark, [tuple(v for v, _ in columns.values())] * 2, tuple(columns))
    assert {r["column"]: r["kind"] for r in column_kinds(df).collect()} == {c: k for c, (_, k) in columns.items()}


def test_kind_uses_the_first_eight_values_wherever_they_are(spark):
    n = 3000
    late = [str(i) if i > 2000 else "" for i in range(n - 1)] + ["word"]
    early = ["1"] * 8 + ["word"] * (n - 8)
    sparse = ["7" if i % 1000 == 999 else None for i in range(n)]
    df = numbered(spark, list(zip(late, early, sparse)), ("late", "early", "sparse")).repartition(4)
    assert {r["column"]: r["kind"] for r in column_kinds(df).collect()} == {
        "late": "Number", "early": "Number", "sparse": "Number",
    }


def test_ranking_is_cut_before_the_shuffle(spark):
    from patternflow.operators.sampling import _cells, _first_k
    from tests.conftest import plan

    df = numbered(spark, ["a", "b"])
    assert "WindowGroupLimit" in plan(_first_k(_cells(df, ["c"], F.col("__rownum"), None), 8))


@pytest.fixture(scope="module")
def written(spark):
    """40 files of 100 rows each; one column holds a value in the last rows only."""
    df = spark.range(4000).select(
        "id",
        F.concat(F.lit("v"), F.col("id") % 700).alias("v"),
        F.when(F.col("id") > 3990, F.col("id").cast("string")).alias("late"),
        F.when(F.col("id") % 2 == 0, F.concat("id", F.lit("@x.com"))).alias("mail"),
    )
    path = write_ordered(df, ["id"], scratch_path(spark, "written"), 40)
    return path, write_page_index(spark, path, scratch_path(spark, "index"))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("k", [3, 10, 450, 1500])
def test_samples_by_position_are_the_samples(spark, written, k):
    path, index = written
    want = sample_values(with_row_numbers(spark, path), ["v", "late", "mail"], k)
    assert same(sample_table(spark, path, ["v", "late", "mail"], k, index_path=index), want)
    assert same(sample_table(spark, path, ["v", "late", "mail"], k), want)


def test_more_values_than_a_ranking_is_cut_to(spark):
    values = [f"m{(i * 7919) % 3001}" for i in range(5000)]
    df = numbered(spark, values).repartition(4)
    assert samples(df, ["c"], 2000, 80) == {"c": brute(values, 2000, 80)}


def test_samples_open_only_the_files_they_visit(spark, written, monkeypatch):
    from patternflow.operators import sampling

    path, index = written
    opened = []
    real = sampling.rows_of
    monkeypatch.setattr(sampling, "rows_of", lambda *a: opened.append(real(*a)) or opened[-1])
    monkeypatch.setattr(sampling, "with_row_numbers", lambda *a, **b: pytest.fail("the whole table was read"))
    assert sample_table(spark, path, ["v", "mail"], 2, index_path=index).count() == 4
    files = {r[0] for r in opened[0].select("_metadata.file_name").distinct().collect()}
    assert len(files) == 2  # rows 0 to 7 and 2000 to 2007 of 4000
    # Other files are not even listed for the scan: with a task for each file there are two.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        sample_table(spark, path, ["v", "mail"], 2, index_path=index)
        parts = opened[-1].rdd.getNumPartitions()
        assert parts < spark.read.parquet(path).rdd.getNumPartitions() / 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_kinds_by_position_are_the_kinds(spark, written, monkeypatch):
    path, index = written
    assert same(table_kinds(spark, path, index_path=index), column_kinds(with_row_numbers(spark, path)))
    from patternflow.operators import sampling

    monkeypatch.setattr(sampling, "with_row_numbers", lambda *a, **b: pytest.fail("the whole table was read"))
    assert dict(map(tuple, table_kinds(spark, path, ["v", "mail"], index_path=index).collect())) == {"v": "Text", "mail": "Email"}
    with pytest.raises(MissingColumnsError):
        table_kinds(spark, path, ["absent"])
