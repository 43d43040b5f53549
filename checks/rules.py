"""Predicates, actions and the entity catalogue over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import checked, lit, register, rule_sql, sql_flag, sql_hit, table
from patternflow import (
    Predicate,
    Rule,
    apply_rule,
    apply_rules,
    entity_rule,
    entity_scan,
    export_csv,
    pattern_of,
    rule_counts,
    run_rule,
    scratch_path,
)
from patternflow.functions import patterns as P

_NULLED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text, lang, source FROM documents)"


def _nulled(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("text")).alias("text")
    return table(spark, d, "documents").select("doc_id", text, "lang", "source")


def _rule_query(name: str, rule: Rule, source: str, columns: list[str], load=None, sql=None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = load(spark, d) if load else table(spark, d, source)
        return apply_rule(df.select(*columns), rule)

    register(name, query, rule_sql(rule, columns, sql or source))


DOCS, PAGES = ["doc_id", "text"], ["page_id", "url", "html"]
PART, CUST = ["p_partkey", "p_name", "p_brand", "p_type"], ["c_custkey", "c_name", "c_mktsegment"]
ORD = ["o_orderkey", "o_orderstatus", "o_orderpriority"]

# Actions, one entity each.
for name, entity, action, value, source, columns, target in [
    ("find_email_documents", "email", "find", "", "documents", DOCS, "text"),
    ("replace_email_documents", "email", "replace", "REDACTED", "documents", DOCS, "text"),
    ("delete_percent_documents", "percent", "replace", "", "documents", DOCS, "text"),
    ("mask_ipv4_documents", "ipv4", "mask", "", "documents", DOCS, "text"),
    ("mask_token_phone_documents", "phone", "mask", "[phone]", "documents", DOCS, "text"),
    ("extract_email_documents", "email", "extract", "", "documents", DOCS, "text"),
    ("extract_url_pages", "url", "extract", "", "pages", PAGES, "html"),
    ("keep_card_documents", "credit_card", "keep", "", "documents", DOCS, "text"),
    ("drop_card_documents", "credit_card", "drop", "", "documents", DOCS, "text"),
    ("mask_mention_documents", "mention", "mask", "", "documents", DOCS, "text"),
    ("strip_html_pages", "html_tag", "replace", "", "pages", PAGES, "html"),
    ("collapse_whitespace_pages", "whitespace", "replace", " ", "pages", PAGES, "html"),
    ("hashtag_customer", "hashtag", "extract", "", "customer", CUST, "c_name"),
    ("phone_customer", "phone", "mask", "", "customer", CUST, "c_name"),
    ("number_events", "number", "replace", "<n>", "events", ["event_id", "props"], "props"),
    ("punctuation_part", "punctuation", "replace", "_", "part", PART, "p_brand"),
    ("alphanumeric_events", "alphanumeric", "extract", "", "events", ["event_id", "props"], "props"),
    ("upper_customer", "uppercase", "mask", "*", "customer", CUST, "c_name"),
    ("lower_part", "lowercase", "replace", "x", "part", PART, "p_name"),
    ("letter_part", "letter", "extract", "", "part", PART, "p_name"),
    ("word_part", "word", "replace", "w", "part", PART, "p_name"),
    ("keep_html_pages", "html_tag", "keep", "", "pages", PAGES, "html"),
    ("drop_number_documents", "number", "drop", "", "documents", DOCS, "text"),
    ("find_date_orders", "date", "find", "", "orders", ["o_orderkey", "o_orderdate"], "o_orderdate"),
    ("find_time_events", "time", "find", "", "events", ["event_id", "ts"], "ts"),
]:
    _rule_query(name, entity_rule(entity, [target], action, value), source, columns)


# A match may end in a space, if a letter follows. The SQL engine knows ASCII letters
# only, so it searches a copy of the text with every letter made an "x".
_card_hit = sql_hit("plain", pattern_of("credit_card"))


@checked(
    f"""SELECT doc_id, CASE WHEN {_card_hit} THEN regexp_extract(plain, {lit(pattern_of("credit_card"))})
    ELSE text END AS text, {_card_hit} AS "__matched__"
    FROM (SELECT doc_id, text, regexp_replace(text, '\\p{{L}}', 'x', 'g') AS plain FROM documents)"""
)
def extract_card_documents(spark: SparkSession, d: str) -> DataFrame:
    rule = entity_rule("credit_card", ["text"], "extract")
    return apply_rule(table(spark, d, "documents").select("doc_id", "text"), rule)


# Combinators.
_two = (Predicate("p_name", "^s"), Predicate("p_brand", "1"))
_rule_query("all_two_columns", Rule(_two, "all", "find"), "part", PART)
_rule_query("any_two_columns", Rule(_two, "any", "find"), "part", PART)
_rule_query("all_two_columns_replace", Rule(_two, "all", "replace", "S"), "part", PART)
_rule_query("any_two_columns_mask", Rule(_two, "any", "mask"), "part", PART)
_rule_query("any_two_columns_extract", Rule(_two, "any", "extract"), "part", PART)
_rule_query("all_two_columns_keep", Rule(_two, "all", "keep"), "part", PART)
_rule_query("any_two_columns_drop", Rule(_two, "any", "drop"), "part", PART)
_rule_query(
    "three_predicates_any",
    Rule((*_two, Predicate("p_type", "C$")), "any", "replace", "?"),
    "part",
    PART,
)

# A condition column gating the edit of another; independent edits; fan-out.
_gate = (Predicate("o_orderstatus", "^F$"), Predicate("o_orderpriority", P.WHOLE_LINE))
_rule_query("gated_edit_orders", Rule(_gate, "all", "replace", "closed"), "orders", ORD)
_rule_query("gated_mask_orders", Rule(_gate, "all", "mask"), "orders", ORD)
_rule_query(
    "independent_edits_part",
    Rule((Predicate("p_brand", r"\d+"), Predicate("p_type", "[AEIOU]")), "any", "replace", "-"),
    "part",
    PART,
)
_rule_query(
    "fanout_pages",
    Rule.fan_out(["url", "html"], pattern_of("number"), "replace", "0"),
    "pages",
    PAGES,
)

# Nulls read as empty text.
_blank = Rule.on("text", P.BLANK, "replace", "(none)")
_rule_query("fill_blank_nulls", _blank, "documents", ["doc_id", "text"], _nulled, _NULLED)
_nulls = (Predicate("lang", "^e"), Predicate("text", pattern_of("number")))
_cols = ["doc_id", "text", "lang"]
_rule_query(
    "any_null_cell_becomes_empty", Rule(_nulls, "any", "replace", "#"), "documents", _cols, _nulled, _NULLED
)
_rule_query(
    "extract_null_stays_null", Rule(_nulls, "any", "extract"), "documents", _cols, _nulled, _NULLED
)
_rule_query("find_blank_nulls", Rule.on("text", P.BLANK), "documents", _cols, _nulled, _NULLED)

# Several predicates on one column apply in turn.
_seq = (Predicate("c_name", "Customer"), Predicate("c_name", "0+"), Predicate("c_name", "#"))
_rule_query("sequential_same_column", Rule(_seq, "all", "replace", "@"), "customer", CUST)
_rule_query("sequential_any_mask", Rule(_seq, "any", "mask", "0#"), "customer", CUST)
_chain = (
    Predicate("c_name", "[a-z]+#[0-9]+"),
    Predicate("c_name", "#[0-9]+"),
    Predicate("c_name", "[1-9]+"),
)
_rule_query("sequential_extract", Rule(_chain, "any", "extract"), "customer", CUST)

# Literal text: replacement characters, and positional matches.
_rule_query("dollar_literal_replace", Rule.on("p_name", "e", "replace", r"$5 \ x$0"), "part", PART)
_rule_query("starts_with_segment", Rule.on("c_mktsegment", P.starts_with("BUILD")), "customer", CUST)
_rule_query("ends_with_segment", Rule.on("c_mktsegment", P.ends_with("RY")), "customer", CUST)
_rule_query(
    "exact_segment", Rule.on("c_mktsegment", P.equals("BUILDING"), "keep"), "customer", CUST
)
_rule_query("whole_word_part", Rule.on("p_name", P.whole_word("ring"), "mask"), "part", PART)
_rule_query(
    "keep_prefix_pages", Rule.on("url", P.starts_with("https"), "keep"), "pages", ["page_id", "url"]
)

# Typed columns are tested, and if edited returned, as text.
_size = ["p_partkey", "p_size"]
_rule_query("numeric_column_cast", Rule.on("p_size", "^1"), "part", _size)
_rule_query("numeric_column_edit", Rule.on("p_size", "^1", "replace", "one-"), "part", _size)
_rule_query("conversation_roles", Rule.on("role", "^(?:user|system)$", "keep"), "conversations", ["conv_id", "turn", "role"])

# The catalogue in one pass. The word entity is left to columns of plain ASCII,
# where both engines agree on what a word boundary is.
_SCANNED = [
    "email", "ipv4", "url", "ssn", "credit_card", "phone", "zip", "uuid", "mac_address",
    "hex_color", "percent", "currency", "date", "time", "hashtag", "mention", "html_tag",
    "whitespace", "number", "alphanumeric", "uppercase", "lowercase", "letter", "punctuation",
]


def _scan_sql(source: str, columns: list[str], entities: list[str]) -> str:
    return " UNION ALL ".join(
        f'SELECT {lit(c)} AS "column", {lit(e)} AS entity, count(*) AS total_rows, '
        f"count(*) FILTER (WHERE {sql_hit(c, pattern_of(e))}) AS matched_rows FROM {source}"
        for c in columns
        for e in entities
    )


for name, source, columns, entities in [
    ("entity_scan_documents", "documents", ["text"], _SCANNED),
    ("entity_scan_pages", "pages", ["url", "html"], _SCANNED),
    ("entity_scan_part", "part", ["p_name", "p_brand", "p_type"], [*_SCANNED, "word"]),
    ("entity_scan_conversations", "conversations", ["role", "text"], _SCANNED),
]:
    register(
        name,
        lambda spark, d, s=source, c=columns, e=entities: entity_scan(table(spark, d, s), c, e),
        _scan_sql(source, columns, entities),
    )

# Entities the tables do not hold, spelled out from customer keys: most cells are
# well formed, every fifth lacks its last character.
_pad = "lpad(CAST(c_custkey % {} AS VARCHAR), {}, '0')"
_k3, _k2, _k4, _k5 = (_pad.format(10**n, n) for n in (3, 2, 4, 5))
_hex = "md5(CAST(c_custkey AS VARCHAR))"
_SPELLED = {
    "ssn": f"{_k3} || '-' || {_k2} || '-' || {_k4}",
    "zip": f"'at ' || {_k5} || '-' || {_k4}",
    "uuid": f"substring({_hex}, 1, 8) || '-' || substring({_hex}, 9, 4) || '-' || substring({_hex}, 13, 4) || '-' || substring({_hex}, 17, 4) || '-' || substring({_hex}, 21, 12)",
    "mac_address": "'mac ' || " + " || ':' || ".join(f"substring({_hex}, {i}, 2)" for i in (1, 5, 9, 13, 17, 21)),
    "hex_color": f"'#' || substring({_hex}, 1, 3)",
    "currency": f"'for $' || CAST(c_custkey AS VARCHAR) || '.' || {_k2}",
    "date": f"'2' || {_k3} || '-0' || CAST(c_custkey % 9 + 1 AS VARCHAR) || '-1' || CAST(c_custkey % 10 AS VARCHAR)",
    "time": f"CAST(c_custkey % 24 AS VARCHAR) || ':1' || CAST(c_custkey % 10 AS VARCHAR)",
    "url": "'see www.' || c_name || '.com'",
    "email": f"c_mktsegment || '@host' || {_k3} || '.org'",
}
_cut = "CASE WHEN c_custkey % 5 = 0 THEN substring({0}, 1, length({0}) - 1) ELSE {0} END AS {1}"
_spelled = "SELECT c_custkey, " + ", ".join(_cut.format(x, n + "_text") for n, x in _SPELLED.items())


@checked(_scan_sql(f"({_spelled} FROM customer)", [n + "_text" for n in _SPELLED], list(_SPELLED)))
def entity_scan_spelled(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "customer").selectExpr(*_split_select())
    return entity_scan(cells, [n + "_text" for n in _SPELLED], list(_SPELLED))


def _split_select() -> list[str]:
    return [_cut.format(x.replace("VARCHAR", "STRING"), n + "_text") for n, x in _SPELLED.items()]


_masked = Rule(tuple(Predicate(n + "_text", pattern_of(n)) for n in _SPELLED), "any", "mask")


@checked(rule_sql(_masked, ["c_custkey", *(n + "_text" for n in _SPELLED)], f"({_spelled} FROM customer)"))
def mask_spelled_entities(spark: SparkSession, d: str) -> DataFrame:
    """Ten entities, each in its own column, masked in one pass."""
    cells = table(spark, d, "customer").selectExpr("c_custkey", *_split_select())
    return apply_rule(cells, _masked)


# Many rules over the same original.
_many = {
    "email": entity_rule("email", ["text"], "replace", "X"),
    "english": Rule.on("lang", "^en$", "keep"),
    "german or digits": Rule((Predicate("lang", "^de$"), Predicate("text", r"\d")), "any"),
    "french with ip": Rule((Predicate("lang", "^fr$"), Predicate("text", pattern_of("ipv4"))), "all"),
}


@checked(
    " UNION ALL ".join(
        f"SELECT {lit(n)} AS rule, count(*) AS total_rows, "
        f"count(*) FILTER (WHERE {sql_flag(r)}) AS matched_rows FROM documents"
        for n, r in _many.items()
    )
)
def run_stats_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return rule_counts(table(spark, d, "documents"), _many)


_passes = {
    "digits": Rule.on("p_brand", r"\d+", "mask"),
    "brand": Rule.on("p_brand", "Brand", "replace", "B"),
    "small": Rule.on("p_name", "^small", "keep"),
}


@checked(
    " UNION ALL ".join(
        f"SELECT {lit(n)} AS run, p_partkey, p_name, p_brand, \"__matched__\" FROM "
        f"({rule_sql(r, ['p_partkey', 'p_name', 'p_brand'], 'part')})"
        for n, r in _passes.items()
    )
)
def repeated_passes_part(spark: SparkSession, d: str) -> DataFrame:
    results = apply_rules(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), _passes)
    first, *rest = (df.withColumn("run", F.lit(n)) for n, df in results.items())
    for df in rest:
        first = first.unionByName(df)
    return first


# The benchmark's rules, so that what is timed is checked as well.
_LINES = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
_rule_query("keep_prefix_lineitem", Rule.on("l_shipdate", "^1996", "keep"), "lineitem", _LINES)

_benched = {e: entity_rule(e, ["text"]) for e in ("email", "ipv4", "phone", "credit_card", "percent")}


@checked(
    " UNION ALL ".join(
        f"SELECT {lit(n)} AS rule, count(*) AS total_rows, count(*) FILTER (WHERE {sql_flag(r)}) AS matched_rows FROM documents"
        for n, r in _benched.items()
    )
)
def rule_counts_documents(spark: SparkSession, d: str) -> DataFrame:
    return rule_counts(table(spark, d, "documents"), _benched)


_half_year = Rule.on("l_shipdate", r"^1996-0[1-6]", "replace", "H1")


@checked(
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag,
    regexp_replace(strftime(l_shipdate, '%Y-%m-%d'), '^1996-0[1-6]', 'H1') AS l_shipdate,
    {sql_hit("strftime(l_shipdate, '%Y-%m-%d')", '^1996-0[1-6]')} AS "__matched__" FROM lineitem"""
)
def run_rule_csv_lineitem(spark: SparkSession, d: str) -> DataFrame:
    lines, out = scratch_path(spark, "lines"), scratch_path(spark, "run")
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")
    export_csv(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", day), lines)
    run_rule(spark, lines, _half_year, out)
    return spark.read.parquet(out)
