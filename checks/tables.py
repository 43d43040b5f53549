"""Sources, sinks, paging and sampling over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import checked, lit, register, rule_sql, sql_hit, sql_list, table
from patternflow import (
    Rule,
    apply_rule,
    apply_rule_stream,
    column_kinds,
    contacts_for,
    entity_rule,
    export_csv,
    inspect_row,
    jump_to_row,
    pattern_of,
    preview,
    read_csv,
    read_drops,
    read_page,
    read_table,
    read_window,
    result_totals,
    run_history,
    run_rule,
    sample_table,
    sample_values,
    scratch_path,
    stage_table,
    table_kinds,
    with_row_numbers,
    write_ordered,
    write_page_index,
    write_result,
)
from patternflow.functions.cells import FORBIDDEN, excel_safe
from patternflow.model import MissingColumnsError
from patternflow.operators.paging import display, matched_view, page_counts
from patternflow.operators.rules import RULE
from patternflow.plans.runs import run_rules
from patternflow.sources import contacts as C
from patternflow.sources.csv_layout import inspect_csv
from patternflow.sources.readers import EmptyTableError
from patternflow.sources.writers import TooLargeForExcel, check_fits_excel
from patternflow.streaming.filedrop import dropped_results, run_rule_drops

# ---- CSV and Parquet round trips -------------------------------------------


def _through_csv(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(spark, label)
    export_csv(df, path)
    return read_csv(spark, path)


_TEXT = {c: f"CAST({c} AS VARCHAR) AS {c}" for c in ("c_custkey", "c_nationkey", "doc_id", "page_id")}


@checked(f"SELECT {_TEXT['c_custkey']}, c_name, {_TEXT['c_nationkey']}, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return _through_csv(spark, df, "csv")


@checked(f"SELECT {_TEXT['doc_id']}, nullif(text, '') AS text, lang FROM documents")
def csv_round_trip_multi_line(spark: SparkSession, d: str) -> DataFrame:
    return _through_csv(spark, table(spark, d, "documents").select("doc_id", "text", "lang"), "csv")


@checked(f"SELECT {_TEXT['doc_id']}, nullif(text, '') AS text FROM documents WHERE {sql_hit('text', pattern_of('email'))}")
def csv_export_matched(spark: SparkSession, d: str) -> DataFrame:
    result, out = scratch_path(spark, "result"), scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "text")
    write_result(apply_rule(docs, entity_rule("email", ["text"])), result)
    export_csv(spark.read.parquet(result), out, matched_only=True)
    return read_csv(spark, out)


_masked = entity_rule("phone", ["text"], "mask")


@checked(rule_sql(_masked, ["doc_id", "text"], "documents"))
def parquet_result_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "result")
    docs = table(spark, d, "documents").select("doc_id", "text")
    write_result(apply_rule(docs, _masked), path)
    return spark.read.parquet(path)


@checked(
    "SELECT doc_id, n_chars, substring(regexp_replace(chr(7) || text || chr(31) || repeat(text, 3), "
    f"{lit(FORBIDDEN)}, '', 'g'), 1, 32767) AS text FROM documents"
)
def excel_safe_cells(spark: SparkSession, d: str) -> DataFrame:
    bell = F.concat(F.lit("\x07"), "text", F.lit("\x1f"), F.repeat("text", 3)).alias("text")
    return excel_safe(table(spark, d, "documents").select("doc_id", "n_chars", bell))


# ---- Row numbers and pages ---------------------------------------------------

_digits = entity_rule("number", ["text"])
_flagged = f"SELECT doc_id, lang, {sql_hit('text', pattern_of('number'))} AS \"__matched__\" FROM documents"
_numbered = f'SELECT *, row_number() OVER (ORDER BY doc_id) AS "__rownum" FROM ({_flagged})'
_matched_order = f'SELECT *, row_number() OVER (ORDER BY "__rownum") AS m FROM ({_numbered}) WHERE "__matched__"'


def _result(spark: SparkSession, d: str, files: int = 7) -> str:
    """Flagged documents written in ``doc_id`` order over several files."""
    flagged = apply_rule(table(spark, d, "documents").select("doc_id", "text", "lang"), _digits)
    return write_ordered(flagged.drop("text"), ["doc_id"], scratch_path(spark, "result"), files)


@checked(_numbered)
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return with_row_numbers(spark, _result(spark, d))


@checked(_numbered)
def row_numbers_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The same with the file offsets broadcast in several slices."""
    return with_row_numbers(spark, _result(spark, d), files_per_broadcast=3)


@checked('SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS "__rownum" FROM customer')
def row_numbers_customer(spark: SparkSession, d: str) -> DataFrame:
    return with_row_numbers(spark, f"{d}/customer.parquet").select("c_custkey", "c_name", "__rownum")


@checked(f'SELECT * FROM ({_numbered}) WHERE "__rownum" BETWEEN 101 AND 150')
def page_full(spark: SparkSession, d: str) -> DataFrame:
    return read_page(spark, _result(spark, d), 3, 50).rows


@checked(f"SELECT * EXCLUDE (m) FROM ({_matched_order}) WHERE m BETWEEN 11 AND 20")
def page_matched(spark: SparkSession, d: str) -> DataFrame:
    return read_page(spark, _result(spark, d), 2, 10, matched_only=True).rows


@checked(f"SELECT * EXCLUDE (m) FROM ({_matched_order}) WHERE m BETWEEN 21 AND 40")
def page_matched_indexed(spark: SparkSession, d: str) -> DataFrame:
    path = _result(spark, d)
    index = write_page_index(spark, path, scratch_path(spark, "index"))
    return read_page(spark, path, 2, 20, matched_only=True, index_path=index).rows


@checked(
    f"""SELECT *, (137 - 1) % 100 AS on_page FROM ({_numbered})
    WHERE "__rownum" BETWEEN 101 AND 200 AND "__rownum" <= (SELECT count(*) FROM documents)"""
)
def jump_row(spark: SparkSession, d: str) -> DataFrame:
    page, index = jump_to_row(spark, _result(spark, d), 137)
    return page.rows.withColumn("on_page", F.lit(index))


@checked(
    """WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
    SELECT 1 AS pos, 'c_custkey' AS "column", 'Number' AS kind, CAST(c_custkey AS VARCHAR) AS value FROM c WHERE n = 42
    UNION ALL SELECT 2, 'c_name', 'Text', c_name FROM c WHERE n = 42
    UNION ALL SELECT 3, 'c_nationkey', 'Number', CAST(c_nationkey AS VARCHAR) FROM c WHERE n = 42
    UNION ALL SELECT 4, 'c_mktsegment', 'Text', c_mktsegment FROM c WHERE n = 42"""
)
def row_inspector(spark: SparkSession, d: str) -> DataFrame:
    shown = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    path = scratch_path(spark, "customer")
    write_ordered(table(spark, d, "customer").select(*shown), ["c_custkey"], path, 4)
    kinds = column_kinds(with_row_numbers(spark, path), shown)
    return inspect_row(spark, path, 42, {r["column"]: r["kind"] for r in kinds.collect()})


@checked(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, coalesce(props, '') AS props,
    row_number() OVER (ORDER BY event_id) AS "__rownum" FROM events
    QUALIFY "__rownum" BETWEEN 400 + 1 AND 400 + 750"""
)
def raw_window_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Three windows in a row, each picking up the cursor of the one before."""
    path = scratch_path(spark, "events")
    events = table(spark, d, "events").select("event_id", "event_type", "props")
    write_ordered(events, ["event_id"], path, 5)
    index = write_page_index(spark, path, scratch_path(spark, "index"))
    cursor, rows = 400, None
    for _ in range(3):
        window = read_window(spark, path, cursor, 250, index_path=index)
        rows = window.rows if rows is None else rows.unionByName(window.rows)
        cursor = window.cursor
    return rows


@checked(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents ORDER BY documents.doc_id LIMIT 20"""
)
def preview_documents(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    write_ordered(docs, ["doc_id"], path, 4)
    return read_window(spark, path, None, 20).rows.drop("__rownum")


@checked(
    f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE "__matched__") AS matched_rows FROM ({_flagged})"""
)
def result_totals_documents(spark: SparkSession, d: str) -> DataFrame:
    return result_totals(spark.read.parquet(_result(spark, d)))


@checked("SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS matched_rows FROM lineitem")
def result_totals_unflagged(spark: SparkSession, d: str) -> DataFrame:
    return result_totals(table(spark, d, "lineitem"))


@checked(
    f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE "__matched__") AS matched_rows,
    greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS num_pages,
    greatest(1, CAST(ceil(count(*) FILTER (WHERE "__matched__") / 50.0) AS BIGINT)) AS matched_pages
    FROM ({_flagged})"""
)
def page_count_documents(spark: SparkSession, d: str) -> DataFrame:
    return page_counts(spark.read.parquet(_result(spark, d)), 50)


@checked(f'SELECT doc_id, lang FROM ({_flagged}) WHERE "__matched__"')
def matched_view_documents(spark: SparkSession, d: str) -> DataFrame:
    return display(matched_view(spark.read.parquet(_result(spark, d))))


@checked("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def matched_view_unflagged(spark: SparkSession, d: str) -> DataFrame:
    """Asking for selected rows of a table without a flag shows all of them."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return display(matched_view(rows))


# ---- Samples and kinds -------------------------------------------------------


def _samples_sql(source: str, key: str, columns: list[str], k: int, max_len: int) -> str:
    cells = " UNION ALL ".join(
        f"""SELECT {lit(c)} AS "column", lap, i,
        substring(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g'), 1, {max_len}) AS value FROM laps"""
        for c in columns
    )
    return f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS i, count(*) OVER () AS n FROM {source}),
    laps AS (SELECT *, i % greatest(1, n // {k}) AS lap FROM numbered),
    cells AS ({cells}),
    met AS (SELECT "column", value, min(lap * 1000000000 + i) AS rank FROM cells WHERE value <> '' GROUP BY ALL),
    placed AS (SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY rank) AS INTEGER) AS pos FROM met)
    SELECT "column", pos, value FROM placed WHERE pos <= {k}"""


for name, source, key, columns, k, max_len in [
    ("sample_values_customer", "customer", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"], 10, 80),
    ("sample_values_events", "events", "event_id", ["event_type", "props", "user_id"], 10, 80),
    ("sample_values_documents", "documents", "doc_id", ["text", "lang", "source"], 8, 40),
    ("sample_values_orders", "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"], 3, 4),
]:
    register(
        name,
        lambda spark, d, s=source, c=columns, k=k, m=max_len: sample_values(
            with_row_numbers(spark, f"{d}/{s}.parquet"), c, k, m
        ),
        _samples_sql(source, key, columns, k, max_len),
    )

# The shapes again, as SQL sees them.
_EMAIL, _URL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"(?i)^https?://|^www\."
_NUM = r"^-?\$?\d[\d,]*\.?\d*%?$"
_DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"


def _kinds_sql(source: str, key: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"""SELECT {lit(c)} AS "column", i, trim(CAST({c} AS VARCHAR)) AS value FROM numbered"""
        for c in columns
    )

    def every(p: str) -> str:
        return f"coalesce(bool_and(regexp_matches(value, {lit(p)})), false)"

    return f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {key}) AS i FROM {source}),
    cells AS ({cells}),
    heads AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY i) AS pos FROM cells WHERE value <> ''),
    names AS (SELECT unnest({sql_list(columns)}) AS "column"),
    shapes AS (SELECT "column", {every(_EMAIL)} AS e, {every(_URL)} AS u, {every(_DATE)} AS t, {every(_NUM)} AS n
      FROM heads WHERE pos <= 8 GROUP BY ALL)
    SELECT "column", CASE
      WHEN contains("column", 'email') OR coalesce(e, false) THEN 'Email'
      WHEN contains("column", 'url') OR contains("column", 'link') OR coalesce(u, false) THEN 'URL'
      WHEN contains("column", 'date') OR contains("column", 'time') OR suffix("column", '_at') OR coalesce(t, false) THEN 'Date / time'
      WHEN "column" = 'id' OR suffix("column", '_id') OR contains("column", 'phone') THEN 'Identifier / number'
      WHEN coalesce(n, false) THEN 'Number' ELSE 'Text' END AS kind
    FROM names LEFT JOIN shapes USING ("column")"""


for source, key, columns in [
    ("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    ("events", "event_id", ["event_id", "ts", "user_id", "event_type", "props"]),
    ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]),
    ("pages", "page_id", ["page_id", "url", "html"]),
]:
    register(
        f"column_kinds_{source}",
        lambda spark, d, s=source, c=columns: column_kinds(
            with_row_numbers(spark, f"{d}/{s}.parquet").select(*c, "__rownum")
        ),
        _kinds_sql(source, key, columns),
    )

def _ordered_events(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "events")
    return write_ordered(table(spark, d, "events").select("event_id", "event_type", "props", "user_id"), ["event_id"], path, 9)


@checked(_samples_sql("events", "event_id", ["event_type", "props", "user_id"], 12, 80))
def sample_table_events(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a written table by position; one column has too few values and is looked up everywhere."""
    return sample_table(spark, _ordered_events(spark, d), ["event_type", "props", "user_id"], 12)


@checked(_samples_sql("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderdate"], 1200, 80))
def sample_table_many_values(spark: SparkSession, d: str) -> DataFrame:
    """More values a column than Spark cuts a ranking to before its shuffle."""
    path, index = scratch_path(spark, "orders"), scratch_path(spark, "index")
    write_ordered(table(spark, d, "orders"), ["o_orderkey"], path, 6)
    write_page_index(spark, path, index)
    return sample_table(spark, path, ["o_orderkey", "o_custkey", "o_orderdate"], 1200, index_path=index)


@checked(_kinds_sql("events", "event_id", ["event_id", "event_type", "props", "user_id"]))
def table_kinds_events(spark: SparkSession, d: str) -> DataFrame:
    return table_kinds(spark, _ordered_events(spark, d))


# ---- Runs, history, streams, generated data ---------------------------------

_cards = entity_rule("credit_card", ["text"], "drop")


@checked(
    f"""SELECT 'SUCCESS' AS status, 'drop' AS action, count(*) AS total_rows,
    count(*) FILTER (WHERE {sql_hit('text', pattern_of('credit_card'))}) AS matched_rows,
    count(*) FILTER (WHERE NOT {sql_hit('text', pattern_of('credit_card'))}) AS output_rows FROM documents"""
)
def run_record(spark: SparkSession, d: str) -> DataFrame:
    runs = scratch_path(spark, "runs")
    source = table(spark, d, "documents").select("doc_id", "text")
    run_rule(spark, source, _cards, scratch_path(spark, "result"), runs_path=runs, dataset="docs")
    return spark.read.parquet(runs).select("status", "action", "total_rows", "matched_rows", "output_rows")


_upper = Rule.on("c_mktsegment", "^[A-M]", "extract")


@checked(
    rule_sql(_upper, ["c_custkey", "c_mktsegment"], "(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer)")
)
def run_result_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """The whole run: CSV in, rule applied, Parquet out."""
    source, dest = scratch_path(spark, "csv"), scratch_path(spark, "result")
    export_csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), source)
    run_rule(spark, source, _upper, dest)
    return spark.read.parquet(dest)


@checked(
    """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS dataset, o_orderdate AS created_at
    FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 50"""
)
def run_history_page(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderdate").alias("created_at"),
    )
    return run_history(runs, "1-URGENT", page=2)


_stream_rule = entity_rule("number", ["c_name"], "mask", "###")


@checked(
    rule_sql(_stream_rule, ["c_custkey", "c_name"], "(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer)")
)
def stream_drain(spark: SparkSession, d: str) -> DataFrame:
    drop, dest = scratch_path(spark, "drop"), scratch_path(spark, "result")
    export_csv(table(spark, d, "customer").select("c_custkey", "c_name").repartition(3), drop)
    stream = read_drops(spark, drop, ["c_custkey", "c_name"], files_per_batch=2)
    apply_rule_stream(stream, _stream_rule, dest, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(dest)


@checked(
    f"""SELECT c.*, 3 AS batches, 5 AS files, t AS total_rows, m AS matched_rows
    FROM ({rule_sql(_stream_rule, ["c_custkey", "c_name"], "(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer)")}) c,
    (SELECT CAST(count(*) AS BIGINT) AS t, CAST(count(*) FILTER (WHERE {sql_hit('c_name', pattern_of('number'))}) AS BIGINT) AS m FROM customer)"""
)
def stream_run_records(spark: SparkSession, d: str) -> DataFrame:
    """Files dropped in, worked off two at a time, next to what the records of these batches add up to."""
    drop, dest, check, runs = (scratch_path(spark, x) for x in ("drop", "result", "checkpoint", "runs"))
    export_csv(table(spark, d, "customer").select("c_custkey", "c_name").repartition(5), drop)
    stream = run_rule_drops(spark, drop, ["c_custkey", "c_name"], _stream_rule, dest, check, runs, stream_id="drops", files_per_batch=2)
    stream.awaitTermination()
    files = F.split("request", " ")[0].cast("int")
    totals = spark.read.parquet(runs).agg(
        F.count(F.lit(1)).cast("int").alias("batches"), F.sum(files).cast("int").alias("files"),
        F.sum("total_rows").alias("total_rows"), F.sum("matched_rows").alias("matched_rows"),
    )
    return dropped_results(spark, dest).select("c_custkey", "c_name", "__matched__").join(F.broadcast(totals))


def _draw_sql(salt: int, bound: int) -> str:
    return (
        f"((((c_custkey % 1000003) * {7919 + 2 * salt} + 42 * 31 + {salt * 104729}) % 1000003)"
        f" * 48271 % 1000003) % {bound}"
    )


def _pick_sql(values: tuple[str, ...], salt: int) -> str:
    return f"list_extract({sql_list(values)}, CAST({_draw_sql(salt, len(values))} + 1 AS BIGINT))"


@checked(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS "ID", f || ' ' || l AS "Name",
    lower(f) || j || lower(l) || '@' || h AS "Email",
    '(' || CAST({_draw_sql(5, 800)} + 200 AS VARCHAR) || ') ' || CAST({_draw_sql(6, 800)} + 200 AS VARCHAR)
      || '-' || CAST({_draw_sql(7, 9000)} + 1000 AS VARCHAR) AS "Phone",
    {_pick_sql(C.NOTES, 8)} AS "Notes"
    FROM (SELECT *, {_pick_sql(C.FIRST, 1)} AS f, {_pick_sql(C.LAST, 2)} AS l,
      {_pick_sql(C.JOINTS, 3)} AS j, {_pick_sql(C.HOSTS, 4)} AS h FROM customer)"""
)
def contacts_generator(spark: SparkSession, d: str) -> DataFrame:
    return contacts_for(table(spark, d, "customer"), "c_custkey", seed=42)


# ---- Row order over several files, and guards ---------------------------------


def _uneven(spark: SparkSession, d: str) -> str:
    """Parts in key order over several files, of which the later are many times larger."""
    path = scratch_path(spark, "uneven")
    filler = F.repeat("p_name", F.when(F.col("p_partkey") > 100, 60).otherwise(1))
    write_ordered(table(spark, d, "part").select("p_partkey", "p_name", filler.alias("filler")), ["p_partkey"], path, 6)
    return path


_PLACES = "SELECT row_number() OVER (ORDER BY p_partkey) AS position, {key} AS p_partkey FROM part"


def _places(spark: SparkSession, path: str) -> DataFrame:
    return with_row_numbers(spark, path, column="position").select("position", "p_partkey")


@checked(_PLACES.format(key="p_partkey"))
def row_numbers_staged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Numbered as a table of more files than are fetched."""
    numbered = with_row_numbers(spark, _uneven(spark, d), column="position", files_fetched=2, files_per_broadcast=4)
    return numbered.select("position", "p_partkey")


@checked(_PLACES.format(key="p_partkey"))
def run_row_order(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "run")
    run_rule(spark, f"{_uneven(spark, d)}/", Rule.on("p_name", "a", "find"), out, kind="parquet")
    return _places(spark, out)


@checked(_PLACES.format(key="CAST(p_partkey AS VARCHAR)"))
def export_row_order(spark: SparkSession, d: str) -> DataFrame:
    """Exported, read as a folder of CSV files by a run, and numbered."""
    out, back = scratch_path(spark, "csv"), scratch_path(spark, "run")
    export_csv(spark.read.parquet(_uneven(spark, d)), out)
    run_rule(spark, out, Rule.on("p_name", "a", "find"), back)
    return _places(spark, back)


@checked(_PLACES.format(key="CAST(p_partkey AS VARCHAR)"))
def staged_row_order(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV files, staged for windows."""
    out, back = scratch_path(spark, "csv"), scratch_path(spark, "staged")
    export_csv(spark.read.parquet(_uneven(spark, d)), out)
    return _places(spark, stage_table(read_csv(spark, out), back))


@checked(f"SELECT * FROM ({_PLACES.format(key='CAST(p_partkey AS VARCHAR)')}) WHERE position <= 20")
def preview_row_order(spark: SparkSession, d: str) -> DataFrame:
    shown = preview(read_table(spark, _uneven(spark, d))).collect()
    return spark.createDataFrame([(i, r["p_partkey"]) for i, r in enumerate(shown, 1)], "position long, p_partkey string")


@checked(
    """SELECT 'columns' AS guard, 'absent' AS verdict UNION ALL SELECT 'header', 'No columns found'
    UNION ALL SELECT 'worksheet', CASE WHEN (SELECT count(*) FROM lineitem) > 5000 THEN 'too large' ELSE 'fits' END"""
)
def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the checks before a run or an export say about the given tables."""
    verdicts = {}
    try:
        apply_rule(table(spark, d, "documents"), Rule.on("absent", "x"))
    except MissingColumnsError as exc:
        verdicts["columns"] = "absent" if "absent" in str(exc) else str(exc)
    blank = scratch_path(spark, "blank")
    table(spark, d, "documents").filter("false").select("text").write.text(blank)
    try:
        read_csv(spark, blank)
    except EmptyTableError as exc:
        verdicts["header"] = str(exc).split(" in ")[0]
    try:
        check_fits_excel(table(spark, d, "lineitem"), max_rows=5001)
        verdicts["worksheet"] = "fits"
    except TooLargeForExcel:
        verdicts["worksheet"] = "too large"
    return spark.createDataFrame(sorted(verdicts.items()), "guard string, verdict string")


# ---- Files cut inside cells, several rules at once, replaced results ---------------


@checked(
    f"SELECT {_TEXT['doc_id']}, nullif(text, '') AS text, lang FROM documents "
    f"UNION ALL SELECT {_TEXT['doc_id']}, 'plain', lang FROM documents"
)
def csv_mixed_folder(spark: SparkSession, d: str) -> DataFrame:
    """One folder with files whose cells span lines, read in stretches, and files without such cells."""
    path = scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(**options).csv(path)
    docs.withColumn("text", F.lit("plain")).repartition(3).write.mode("append").options(**options).csv(path)
    return read_csv(spark, path, layout=inspect_csv(spark, path, cut_above=0))


@checked('SELECT l_returnflag AS a0, l_linestatus AS "A1", CAST(l_orderkey AS VARCHAR) AS b FROM lineitem')
def csv_same_name_twice(spark: SparkSession, d: str) -> DataFrame:
    """A folder of several files that all have the header ``a,A,b``."""
    path = scratch_path(spark, "csv")
    lines = table(spark, d, "lineitem").select(F.concat_ws(",", "l_returnflag", "l_linestatus", "l_orderkey").alias("line"), "l_linenumber")
    header = table(spark, d, "region").limit(1).select(F.lit("a,A,b").alias("line"))
    for own in (F.col("l_linenumber") < 3, F.col("l_linenumber") >= 3):
        header.union(lines.filter(own).select("line")).coalesce(1).write.mode("append").text(path)
    return read_csv(spark, path)


_five = {
    "mask_phone": entity_rule("phone", ["text"], "mask"),
    "keep_email": entity_rule("email", ["text"], "keep"),
    "drop_card": entity_rule("credit_card", ["text"], "drop"),
    "find_number": _digits,
    "upper_lang": Rule.on("lang", "^[a-m]", "replace", "X"),
}


@checked(
    " UNION ALL ".join(f"SELECT {lit(n)} AS rule, * FROM ({rule_sql(r, ['doc_id', 'text', 'lang'], 'documents')})" for n, r in _five.items())
)
def run_rules_one_read(spark: SparkSession, d: str) -> DataFrame:
    """The results of five rules, written by one job that opens the table once."""
    dest = scratch_path(spark, "many")
    run_rules(spark, table(spark, d, "documents").select("doc_id", "text", "lang"), _five, dest)
    return spark.read.parquet(dest).withColumnRenamed(RULE, "rule").select("rule", "doc_id", "text", "lang", "__matched__")


@checked(
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, true AS "__matched__", n AS "__rownum", t AS total
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS t FROM orders WHERE starts_with(o_orderpriority, '2'))
    WHERE n BETWEEN 101 AND 150"""
)
def page_of_replaced_result(spark: SparkSession, d: str) -> DataFrame:
    """A page through the index of a result that another run has replaced since."""
    source, dest, index = (scratch_path(spark, x) for x in ("orders", "result", "index"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority", F.col("o_orderkey").alias("k"))
    write_ordered(orders, ["k"], source, 4)
    placed = spark.read.parquet(source).drop("k")
    run_rule(spark, placed, Rule.on("o_orderpriority", "^1", "keep"), dest, index_path=index)
    run_rule(spark, placed, Rule.on("o_orderpriority", "^2", "keep"), dest)
    page = read_page(spark, dest, 3, 50, index_path=index)
    return page.rows.withColumn("total", F.lit(page.total).cast("long"))
