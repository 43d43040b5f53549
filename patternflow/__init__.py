"""patternflow: find, edit and filter rows by text patterns, on Spark."""

from patternflow.functions.entities import BY_NAME, CATALOGUE, pattern_of
from patternflow.functions.matching import match_condition
from patternflow.model import FLAG, ROW_NUMBER, MissingColumnsError, Predicate, Rule, RuleError
from patternflow.operators.entities import entity_rule, entity_scan
from patternflow.operators.numbering import with_row_numbers, write_ordered
from patternflow.operators.paging import (
    inspect_row,
    jump_to_row,
    page_count,
    read_page,
    read_window,
    result_totals,
    write_page_index,
)
from patternflow.operators.rules import apply_rule, apply_rules, rule_counts
from patternflow.operators.sampling import column_kinds, sample_table, sample_values, samples_map, table_kinds
from patternflow.plans.datasets import register_dataset
from patternflow.plans.lint import check_pattern, lint_rules, validate_rules
from patternflow.plans.prompts import resolve_prompts, rule_from_prompt, rule_summary
from patternflow.plans.requests import request_key, resolve_with_reuse
from patternflow.plans.runs import RunStats, run_history, run_request, run_rule, run_rules
from patternflow.session import build_session, scratch_path
from patternflow.sources.contacts import contacts, contacts_for
from patternflow.sources.readers import detect_kind, preview, read_csv, read_table
from patternflow.sources.writers import export, export_csv, export_excel, stage_table, write_result
from patternflow.streaming.filedrop import StreamCounts, apply_rule_stream, read_drops

__all__ = [
    "BY_NAME", "CATALOGUE", "FLAG", "ROW_NUMBER", "MissingColumnsError", "Predicate", "Rule",
    "RuleError", "RunStats", "StreamCounts", "apply_rule", "apply_rule_stream", "apply_rules",
    "build_session", "check_pattern", "column_kinds", "contacts", "contacts_for", "detect_kind",
    "entity_rule", "entity_scan", "export", "export_csv", "export_excel", "inspect_row",
    "jump_to_row", "lint_rules", "match_condition", "page_count", "pattern_of", "preview",
    "read_csv", "read_drops", "read_page", "read_table", "read_window", "request_key",
    "resolve_prompts", "resolve_with_reuse", "result_totals", "rule_counts", "rule_from_prompt",
    "rule_summary", "register_dataset", "run_history", "run_request", "run_rule", "run_rules", "sample_table",
    "sample_values", "samples_map", "scratch_path", "stage_table", "table_kinds", "validate_rules", "with_row_numbers", "write_ordered", "write_page_index",
    "write_result",
]
