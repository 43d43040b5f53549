"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores. Every query runs once to warm up, then three times; the median counts.
Results are computed in full: written to a no-op sink, or fetched where the
answer is a page or a handful of counters.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from patternflow import (
    Rule,
    apply_rule,
    build_session,
    entity_rule,
    entity_scan,
    export_csv,
    lint_rules,
    read_csv,
    read_page,
    resolve_prompts,
    rule_counts,
    run_rule,
    sample_values,
    scratch_path,
    with_row_numbers,
    write_ordered,
    write_page_index,
)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3


def compute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    t = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "pages", "customer", "conversations", "lineitem")}
    docs, pages = t["documents"], t["pages"]

    result = write_ordered(
        apply_rule(docs, entity_rule("number", ["text"])), ["doc_id"], scratch_path(spark, "bench"), 16
    )
    index = write_page_index(spark, result, scratch_path(spark, "bench-index"))
    many = {e: entity_rule(e, ["text"]) for e in ("email", "ipv4", "phone", "credit_card", "percent")}
    turns = t["conversations"].select(F.col("text").alias("prompt"), F.array(F.lit("text")).alias("columns"))

    def csv_round_trip():
        path = scratch_path(spark, "bench-csv")
        export_csv(docs.select("doc_id", "text", "lang"), path)
        compute(read_csv(spark, path))

    lines = scratch_path(spark, "bench-lines")
    export_csv(t["lineitem"].select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"), lines)

    def csv_run():
        rule = Rule.on("l_shipdate", r"^1996-0[1-6]", "replace", "H1")
        run_rule(spark, lines, rule, scratch_path(spark, "bench-run"))

    def one_run():
        run_rule(spark, docs, entity_rule("email", ["text"], "mask"), scratch_path(spark, "bench-run"))

    queries = {
        "replace_email_documents": lambda: compute(apply_rule(docs, entity_rule("email", ["text"], "replace", "REDACTED"))),
        "mask_ipv4_documents": lambda: compute(apply_rule(docs, entity_rule("ipv4", ["text"], "mask"))),
        "extract_url_pages": lambda: compute(apply_rule(pages, entity_rule("url", ["html"], "extract"))),
        "keep_card_documents": lambda: compute(apply_rule(docs, entity_rule("credit_card", ["text"], "keep"))),
        "strip_html_pages": lambda: compute(apply_rule(pages, entity_rule("html_tag", ["html"], "replace"))),
        "keep_prefix_lineitem": lambda: compute(apply_rule(t["lineitem"], Rule.on("l_shipdate", "^1996", "keep"))),
        "entity_scan_documents": lambda: entity_scan(docs, ["text"]).collect(),
        "rule_counts_documents": lambda: rule_counts(docs, many).collect(),
        "run_rule_documents": one_run,
        "run_rule_csv_lineitem": csv_run,
        "page_matched": lambda: read_page(spark, result, 3, 50, True, index_path=index).rows.collect(),
        "row_numbers": lambda: compute(with_row_numbers(spark, result)),
        "sample_values_documents": lambda: sample_values(
            with_row_numbers(spark, f"{SF_DIR}/documents.parquet"), ["text", "lang", "source"]
        ).collect(),
        "csv_round_trip": csv_round_trip,
        "resolve_prompts_conversations": lambda: compute(resolve_prompts(turns)),
        "lint_documents": lambda: compute(lint_rules(docs.select("doc_id", "text"), "text", trial=False)),
    }
    chosen = sys.argv[1:] or list(queries)
    times = {}
    for name in chosen:
        queries[name]()
        took = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            queries[name]()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
