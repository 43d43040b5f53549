"""Requests, actions, pattern checks and reuse, over requests made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import checked, lit, sql_list, table
from patternflow import lint_rules, resolve_prompts, rule_summary, scratch_path, validate_rules
from patternflow.functions.entities import GENERIC, SPECIFIC, pattern_of
from patternflow.functions.matching import match_condition
from patternflow.model import Predicate
from patternflow.plans import lint as L
from patternflow.plans import prompts as R
from patternflow.plans.requests import (
    STORE_SCHEMA,
    context_signature,
    create_store,
    request_key,
    resolve_with_reuse,
    with_keys,
)

# Pieces of requests, combined by a table's key.
VERBS = [
    "redact", "find", "replace the", "extract", "keep only rows with", "drop rows with a", "remove",
    "please look at", "highlight", "pull out", "swap", "Update the", "Delete rows holding",
]
THINGS = [
    "email addresses", "IP Address values", "hyperlinks", "social security numbers", "card numbers",
    "phone", "postal codes", "GUIDs", "mac address", "color codes", "percentages", "£ amounts",
    "birthdays", "timestamps", "hashtags", "usernames", "html tags", "extra whitespace", "digits",
    "uppercase runs", "lowercase", "letters", "punctuation marks", "words", "recipients", "updates",
    "text", "rows",
]
CUES = [
    "is exactly", "equals", "starts with", "beginning  with", "ends with", "ending with", "has",
    "mentions the word", "begin with",
]
TAILS = ["", " with N/A", ' with "hidden"', " with the  $x ", " in every column"]


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"list_extract({sql_list(values)}, CAST({key} % {len(values)} + 1 AS BIGINT))"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests derived from parts: half name an entity, half quote the part's name."""
    k = F.col("p_partkey")
    entity = F.concat_ws(" ", _pick(VERBS, k), _pick(THINGS, k))
    quoted = F.concat(
        _pick(VERBS, k), F.lit(" where it "), _pick(CUES, k), F.lit(" '"), "p_name", F.lit(" ("),
        "p_brand", F.lit(".*)'"),
    )
    prompt = F.concat(F.when(k % 2 == 0, entity).otherwise(quoted), _pick(TAILS, F.floor(k / 7)))
    columns = (
        F.when(k % 11 == 0, F.array().cast("array<string>"))
        .when(k % 3 == 0, F.array(F.lit("text")))
        .otherwise(F.array(F.lit("Work"), "p_type"))
    )
    return table(spark, d, "part").select(
        k.alias("id"),
        prompt.alias("prompt"),
        columns.alias("columns"),
        _pick(["auto", "auto", "mask", "keep"], k).alias("asked"),
        _pick(["", "typed", ""], k).alias("typed"),
    )


REQUESTS = f"""(SELECT p_partkey AS id,
  (CASE WHEN p_partkey % 2 = 0 THEN {_pick_sql(VERBS, 'p_partkey')} || ' ' || {_pick_sql(THINGS, 'p_partkey')}
   ELSE {_pick_sql(VERBS, 'p_partkey')} || ' where it ' || {_pick_sql(CUES, 'p_partkey')} || ' ''' || p_name || ' (' || p_brand || '.*)''' END)
   || {_pick_sql(TAILS, '(p_partkey // 7)')} AS prompt,
  CASE WHEN p_partkey % 11 = 0 THEN CAST([] AS VARCHAR[]) WHEN p_partkey % 3 = 0 THEN ['text'] ELSE ['Work', p_type] END AS columns,
  {_pick_sql(["auto", "auto", "mask", "keep"], 'p_partkey')} AS asked,
  {_pick_sql(["", "typed", ""], 'p_partkey')} AS typed FROM part)"""


def _keyword_sql(text: str, keyword: str) -> str:
    if keyword[0].isalnum():
        quoted = keyword.replace("-", "\\-")
        return f"regexp_matches({text}, {lit('(^|[^a-z0-9])' + quoted)})"
    return f"contains({text}, {lit(keyword)})"


def _entities_sql(entities, field: str, text: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(_keyword_sql(text, k) for k in e.keywords)} THEN {lit(getattr(e, field))}"
        for e in entities
    )
    return f"CASE {whens} END"


_QUOTED = lit(R.QUOTED)
_SPECIALS = lit(r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])")


def _pattern_sql(prompt: str) -> str:
    low = f"lower({prompt})"
    literal = f"regexp_replace(regexp_extract({prompt}, {_QUOTED}, 1), {_SPECIALS}, '\\\\\\1', 'g')"
    return f"""coalesce({_entities_sql(SPECIFIC, 'pattern', low)},
      CASE WHEN regexp_matches({prompt}, {_QUOTED}) THEN
        CASE WHEN regexp_matches({low}, {lit(R.EXACT_CUE)}) THEN '^' || {literal} || '$'
             WHEN regexp_matches({low}, {lit(R.START_CUE)}) THEN '^' || {literal}
             WHEN regexp_matches({low}, {lit(R.END_CUE)}) THEN {literal} || '$'
             ELSE '\\b' || {literal} || '\\b' END END,
      {_entities_sql(GENERIC, 'pattern', low)})"""


def _explanation_sql(prompt: str) -> str:
    low = f"lower({prompt})"
    return f"""coalesce({_entities_sql(SPECIFIC, 'explanation', low)},
      CASE WHEN regexp_matches({prompt}, {_QUOTED}) THEN
        CASE WHEN regexp_matches({low}, {lit(R.EXACT_CUE)}) THEN 'The whole cell is the quoted text.'
             WHEN regexp_matches({low}, {lit(R.START_CUE)}) THEN 'The cell opens with the quoted text.'
             WHEN regexp_matches({low}, {lit(R.END_CUE)}) THEN 'The quoted text closes the cell.'
             ELSE 'The quoted text stands somewhere in the cell.' END END,
      {_entities_sql(GENERIC, 'explanation', low)})"""


def _action_sql(prompt: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({prompt}), {lit(p)})' for p in phrases)} THEN {lit(action)}"
        for action, phrases in R.ACTION_PHRASES
    )
    return f"CASE {whens} ELSE 'replace' END"


def _value_sql(prompt: str, verb: str) -> str:
    found = f"trim(regexp_extract({prompt}, {lit(R.WITH_VALUE)}, 1))"
    return f"CASE WHEN {verb} = 'replace' THEN {found} ELSE '' END"


_USER = "(SELECT conv_id, turn, text FROM conversations)"


@checked(
    f"SELECT conv_id, turn, {_pattern_sql('text')} AS pattern, {_explanation_sql('text')} AS explanation FROM {_USER}"
)
def derive_pattern_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, quoted-text and generic rules over whole conversation turns."""
    found = table(spark, d, "conversations").withColumn("f", R.derive_pattern(F.col("text")))
    return found.select("conv_id", "turn", "f.pattern", "f.explanation")


@checked(f"SELECT id, {_pattern_sql('prompt')} AS pattern FROM {REQUESTS}")
def derive_pattern_requests(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("id", R.derive_pattern(F.col("prompt"))["pattern"].alias("pattern"))


@checked(f"SELECT conv_id, turn, {_action_sql('text')} AS action FROM {_USER}")
def infer_action_conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        "conv_id", "turn", R.infer_action(F.col("text")).alias("action")
    )


@checked(
    f"SELECT id, verb, {_value_sql('prompt', 'verb')} AS value FROM (SELECT *, {_action_sql('prompt')} AS verb FROM {REQUESTS})"
)
def inline_value_requests(spark: SparkSession, d: str) -> DataFrame:
    df = requests(spark, d).withColumn("verb", R.infer_action(F.col("prompt")))
    return df.select("id", "verb", R.inline_value(F.col("prompt"), F.col("verb")).alias("value"))


_RESOLVED = f"""SELECT *,
  CASE WHEN asked = 'auto' THEN verb ELSE asked END AS action,
  CASE WHEN asked = 'auto' THEN coalesce(nullif(typed, ''), {_value_sql('prompt', 'verb')}) ELSE typed END AS value,
  CASE WHEN len(columns) = 0 THEN {lit(R.NO_COLUMNS)} WHEN pattern IS NULL THEN {lit(R.NOT_DERIVED)} END AS error
  FROM (SELECT *, {_action_sql('prompt')} AS verb, {_pattern_sql('prompt')} AS pattern,
    {_explanation_sql('prompt')} AS explanation FROM {REQUESTS})"""


@checked(
    f"""SELECT id, action, value, error, 'heuristic' AS source,
    CASE WHEN error IS NULL THEN 'any' END AS combinator,
    CASE WHEN error IS NULL THEN explanation END AS explanation,
    CASE WHEN error IS NULL THEN CAST(len(columns) AS INTEGER) END AS n_predicates,
    CASE WHEN error IS NULL THEN columns[1] END AS first_column,
    CASE WHEN error IS NULL THEN columns[-1] END AS last_column,
    CASE WHEN error IS NULL THEN pattern END AS pattern
    FROM ({_RESOLVED})"""
)
def resolve_prompts_requests(spark: SparkSession, d: str) -> DataFrame:
    out = resolve_prompts(requests(spark, d), action="asked", value="typed")
    last = F.col("predicates")[F.size("predicates") - 1]
    return out.select(
        "id", "action", "value", "error", "source", "combinator", "explanation",
        F.when(F.col("error").isNull(), F.size("predicates")).alias("n_predicates"),
        F.col("predicates")[0]["column"].alias("first_column"),
        last["column"].alias("last_column"),
        last["pattern"].alias("pattern"),
    )


_ASKED = ["auto", "mask", "auto", "keep", "auto", "extract"]
_INFERRED = ["replace", "nonsense", "auto", "extract", "drop"]


@checked(
    f"""SELECT event_id,
    CASE WHEN a <> 'auto' THEN a WHEN i IN ('find', 'replace', 'mask', 'extract', 'keep', 'drop') THEN i ELSE 'replace' END AS action,
    CASE WHEN a <> 'auto' THEN t WHEN t <> '' THEN t ELSE coalesce(v, '') END AS value
    FROM (SELECT event_id, {_pick_sql(_ASKED, 'event_id')} AS a,
      CASE WHEN event_id % 17 = 0 THEN NULL ELSE {_pick_sql(_INFERRED, 'event_id')} END AS i,
      CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS t,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS v FROM events)"""
)
def resolve_actions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    inferred = F.when(k % 17 != 0, _pick(_INFERRED, k))
    typed = F.when(k % 4 == 0, F.col("event_type")).otherwise("")
    action, value = R.resolve_action(_pick(_ASKED, k), typed, inferred, F.when(k % 3 != 0, F.col("props")))
    return table(spark, d, "events").select(k, action.alias("action"), value.alias("value"))


_SUMMARY = f"""CASE WHEN error IS NOT NULL THEN '' WHEN len(columns) = 1 THEN pattern
  ELSE columns[1] || ' ~ /' || pattern || '/ OR ' || columns[2] || ' ~ /' || pattern || '/' END"""


@checked(f"SELECT id, {_SUMMARY} AS summary FROM ({_RESOLVED})")
def rule_summary_requests(spark: SparkSession, d: str) -> DataFrame:
    out = resolve_prompts(requests(spark, d))
    return out.select("id", rule_summary(F.col("predicates"), F.col("combinator")).alias("summary"))


# ---- Pattern checks ----------------------------------------------------------


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """Good and bad patterns built around each part's name."""
    k, name = F.col("p_partkey"), F.col("p_name")
    kind = k % 8
    pattern = (
        F.when(kind == 0, F.concat(F.lit(r"\b"), name, F.lit(r"\b")))
        .when(kind == 1, F.concat(F.lit("([a-z]+"), name))
        .when(kind == 2, F.concat(F.lit("("), name, F.lit("+)+$")))
        .when(kind == 3, F.repeat(F.concat(name, F.lit(" ")), 600))
        .when(kind == 4, F.regexp_replace(name, ".", " "))
        .when(kind == 5, F.concat(F.lit(r"\p{L}+(?<w>"), name, F.lit(r")\b\d++\h?")))
        .when(kind == 6, F.lit("^(a|aa)+$"))
    )
    return table(spark, d, "part").select(k.alias("id"), kind.alias("kind"), pattern.alias("pattern"))


_PATTERNS = r"""(SELECT p_partkey AS id, p_partkey % 8 AS kind, CASE p_partkey % 8
  WHEN 0 THEN '\b' || p_name || '\b' WHEN 1 THEN '([a-z]+' || p_name WHEN 2 THEN '(' || p_name || '+)+$'
  WHEN 3 THEN repeat(p_name || ' ', 600) WHEN 4 THEN regexp_replace(p_name, '.', ' ', 'g')
  WHEN 5 THEN '\p{L}+(?<w>' || p_name || ')\b\d++\h?' WHEN 6 THEN '^(a|aa)+$' END AS pattern FROM part)"""


def _static_sql(p: str) -> str:
    return f"""CASE WHEN {p} IS NULL OR trim({p}) = '' THEN {lit(L.EMPTY)}
      WHEN length({p}) > 2000 THEN {lit(L.TOO_LONG)}
      WHEN regexp_matches({p}, {lit(L.NESTED_QUANTIFIER)}) THEN {lit(L.NESTED)} END"""


@checked(f"SELECT id, {_static_sql('pattern')} AS reason FROM {_PATTERNS}")
def lint_static(spark: SparkSession, d: str) -> DataFrame:
    return lint_rules(_patterns(spark, d), trial=False).select("id", "reason")


@checked(f"SELECT doc_id, {_static_sql('text')} AS reason FROM documents")
def lint_static_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole document texts taken as patterns: long, odd and many."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lint_rules(docs, "text", trial=False).select("doc_id", "reason")


@checked(
    f"""SELECT id, reason IS NULL AS ok, reason FROM (SELECT id, CASE kind WHEN 1 THEN {lit(L.INVALID)}
    WHEN 2 THEN {lit(L.NESTED)} WHEN 3 THEN {lit(L.TOO_LONG)} WHEN 4 THEN {lit(L.EMPTY)}
    WHEN 6 THEN {lit(L.SLOW)} WHEN 7 THEN {lit(L.EMPTY)} END AS reason FROM {_PATTERNS})"""
)
def lint_trial(spark: SparkSession, d: str) -> DataFrame:
    """With the compile check, the check for ambiguity and the trial on the four texts; the kinds are bad by construction."""
    return lint_rules(_patterns(spark, d)).select("id", "ok", "reason")


_JAVA_ONLY = [r"\Q%s\E", r"\pL+%s", r"%s\z", r"\x{41}%s", r"(?U)\w+%s", r"(?<=a{1,3})%s", r"\G\d%s"]
_PYTHON_ONLY = [r"(?P<n>%s)", r"%s{,3}", r"(?a)%s"]


@checked(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 6 THEN {lit(L.INVALID)} END AS reason FROM part")
def lint_engine_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms that only one of two engines knows: the one that runs them decides."""
    forms = F.array(*[F.lit(f) for f in _JAVA_ONLY + _PYTHON_ONLY])
    k = F.col("p_partkey")
    pattern = F.replace(F.get(forms, (k % 10).cast("int")), F.lit("%s"), F.col("p_name"))
    df = table(spark, d, "part").select(k.alias("id"), pattern.alias("pattern"))
    return lint_rules(df).select("id", "reason")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")

    def pred(column, pattern):
        return F.struct(column.alias("column"), pattern.alias("pattern"))

    bad_column = F.when(k % 5 == 0, F.lit("Elsewhere")).otherwise("B")
    preds = F.array(pred(F.lit("A"), F.lit(r"^\d+$")), pred(bad_column, F.col("pattern")))
    none = F.array().cast("array<struct<column:string,pattern:string>>")
    return _patterns(spark, d).select(
        "id",
        F.when(k % 13 == 0, none).otherwise(preds).alias("predicates"),
        F.array(F.lit("A"), F.lit("B")).alias("columns"),
        _pick(["all", "any", "xor"], k).alias("combinator"),
    )


@checked(
    f"""SELECT id, CASE WHEN id % 3 = 1 THEN 'any' ELSE 'all' END AS combinator,
    CASE WHEN id % 13 = 0 THEN 'No match condition.' WHEN id % 5 = 0 THEN 'Not a target column: Elsewhere'
    ELSE {_static_sql('pattern')} END AS error FROM {_PATTERNS}"""
)
def validate_conditions(spark: SparkSession, d: str) -> DataFrame:
    return validate_rules(_rules(spark, d), trial=False).select("id", "combinator", "error")


@checked(
    f"""SELECT id, CASE WHEN id % 13 = 0 THEN 'No match condition.' WHEN id % 5 = 0 THEN 'Not a target column: Elsewhere'
    ELSE CASE kind WHEN 1 THEN {lit(L.INVALID)} WHEN 2 THEN {lit(L.NESTED)} WHEN 3 THEN {lit(L.TOO_LONG)}
    WHEN 4 THEN {lit(L.EMPTY)} WHEN 6 THEN {lit(L.SLOW)} WHEN 7 THEN {lit(L.EMPTY)} END END AS error FROM {_PATTERNS}"""
)
def validate_conditions_trial(spark: SparkSession, d: str) -> DataFrame:
    return validate_rules(_rules(spark, d)).select("id", "error")


# ---- Keys and reuse ----------------------------------------------------------

_SPACE = r"[\pZ\s\x0B\x1c-\x1f\x{85}]"


def _norm_sql(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower({text}), {lit(f'^{_SPACE}+|{_SPACE}+$')}, '', 'g'), "
        f"{lit(f'{_SPACE}+')}, ' ', 'g')"
    )


@checked(f"SELECT conv_id, turn, sha256('heuristic:v1::' || {_norm_sql('text')} || '::') AS key FROM conversations")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        "conv_id", "turn", request_key(F.col("text")).alias("key")
    )


@checked(
    f"""SELECT conv_id, turn, sha256('m1::' || {_norm_sql('text')} || '::' ||
    '{{"action":"mask","columns":["B","' || role || '"],"samples":{{"B":["' || role || '"],"a":["1","x"]}}}}') AS key
    FROM conversations"""
)
def request_keys_with_context(spark: SparkSession, d: str) -> DataFrame:
    samples = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("x")), F.lit("B"), F.array("role"))
    context = context_signature(F.array(F.lit("B"), "role"), samples, F.lit("mask"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", request_key(F.col("text"), "m1", context).alias("key")
    )


@checked(
    f"""WITH asked AS (SELECT *, CASE WHEN len(columns) = 0 OR pattern IS NULL THEN 0 ELSE 1 END AS fine,
      {_norm_sql('prompt')} || '::' || array_to_string(columns, ',') AS k FROM ({_RESOLVED})),
    firsts AS (SELECT k, min(id % 4) = 0 AS known, arg_min(pattern, prompt) AS pattern,
      arg_min(verb, prompt) AS verb, arg_min({_value_sql('prompt', 'verb')}, prompt) AS inline FROM asked GROUP BY k)
    SELECT a.id, CASE WHEN known AND fine = 1 THEN 'cache' ELSE 'heuristic' END AS source,
      CASE WHEN known AND fine = 1 THEN 'stored' WHEN fine = 1 THEN f.pattern END AS pattern,
      CASE WHEN asked <> 'auto' THEN asked WHEN known AND fine = 1 THEN 'mask' ELSE f.verb END AS action,
      CASE WHEN asked <> 'auto' THEN typed WHEN typed <> '' THEN typed WHEN known AND fine = 1 THEN '*' ELSE f.inline END AS value
    FROM asked a JOIN firsts f USING (k)"""
)
def reuse_resolved(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the requests are in the store already, with answers of their own."""
    store, asked = scratch_path(spark, "store"), requests(spark, d)
    known = resolve_prompts(asked.filter(F.col("id") % 4 == 0)).filter(F.col("error").isNull())
    stored = F.array(F.struct(F.lit("text").alias("column"), F.lit("stored").alias("pattern"), F.lit("").alias("explanation")))
    with_keys(known).select(
        "key", stored.alias("predicates"), F.lit("any").alias("combinator"),
        F.lit("").alias("explanation"), F.lit("mask").alias("action"), F.lit("*").alias("value"),
        F.current_timestamp().alias("created_at"),
    ).to(spark.createDataFrame([], STORE_SCHEMA).schema).write.parquet(store)
    out = resolve_with_reuse(spark, asked, store, action="asked", value="typed")
    return out.select("id", "source", F.col("predicates")[0]["pattern"].alias("pattern"), "action", "value")


@checked(
    f"""SELECT flag, pattern, action, 'heuristic' AS source, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders
    FROM (SELECT l_orderkey, l_returnflag AS flag,
      CASE l_returnflag WHEN 'A' THEN {lit(pattern_of('email'))} WHEN 'N' THEN {lit(pattern_of('phone'))} ELSE {lit(pattern_of('url'))} END AS pattern,
      CASE l_returnflag WHEN 'A' THEN 'find' WHEN 'N' THEN 'mask' ELSE 'drop' END AS action FROM lineitem) GROUP BY ALL"""
)
def reuse_hot_requests(spark: SparkSession, d: str) -> DataFrame:
    """Two requests that hold a third of all rows each, which join by broadcast, and fifty others, which are shuffled."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"))
    rare = F.concat(F.lit("drop rows with urls, group "), F.pmod("l_orderkey", F.lit(50)))
    prompt = F.when(F.col("flag") == "A", "find emails").when(F.col("flag") == "N", "mask  the phone numbers").otherwise(rare)
    asked = lines.select("l_orderkey", "flag", prompt.alias("prompt"), F.array(F.lit("text")).alias("columns"))
    out = resolve_with_reuse(spark, asked, create_store(spark, scratch_path(spark, "store")))
    out = out.select("flag", F.col("predicates")[0]["pattern"].alias("pattern"), "action", "source", "l_orderkey")
    return out.groupBy("flag", "pattern", "action", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"))


@checked(
    f"""SELECT n_nationkey, regexp_matches(n_name, '1') AND regexp_matches(CAST(n_regionkey AS VARCHAR), '^[0-2]') AS hit FROM nation"""
)
def match_condition_column(spark: SparkSession, d: str) -> DataFrame:
    """The condition on its own, as a column."""
    test = match_condition([Predicate("n_name", "1"), Predicate("n_regionkey", "^[0-2]")], "all")
    return table(spark, d, "nation").select("n_nationkey", test.alias("hit"))
