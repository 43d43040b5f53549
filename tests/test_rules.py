"""The rule contract on small tables, and against a plain Python model."""

import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from patternflow import (
    FLAG,
    MissingColumnsError,
    Predicate,
    Rule,
    RuleError,
    apply_rule,
    entity_scan,
    match_condition,
    rule_counts,
)
from patternflow.functions.patterns import quote_regex, quote_replacement
from tests.conftest import plan


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("Ann", "012"), ("Abe", "912"), ("Bob", "034"), ("Cy", None)], "name string, phone string"
    )


def test_golden_replace(spark):
    df = spark.createDataFrame(
        [("John Doe", "1", "john.doe@example.com"), ("Jane Smith", "2", "jane_s@domain.com")],
        "Name string, ID string, Email string",
    )
    rule = Rule.on("Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b", "replace", "REDACTED")
    out = apply_rule(df, rule)
    assert out.columns == ["Name", "ID", "Email", FLAG]
    assert {r["Email"] for r in out.collect()} == {"REDACTED"}


def test_all_any_and_single(people):
    preds = [Predicate("name", "^A"), Predicate("phone", "^0")]
    both = people.filter(match_condition(preds, "all"))
    either = people.filter(match_condition(preds, "any"))
    one = people.filter(match_condition(preds[:1]))
    assert [r["name"] for r in both.collect()] == ["Ann"]
    assert [r["name"] for r in either.collect()] == ["Ann", "Abe", "Bob"]
    assert [r["name"] for r in one.collect()] == ["Ann", "Abe"]


def test_unknown_combinator_means_all():
    assert Rule((Predicate("a", "x"),), "xor").combinator == "all"


def test_mask_writes_one_token_per_match(spark):
    df = spark.createDataFrame([("ab12cd345",)], "c string")
    assert rows(apply_rule(df, Rule.on("c", r"\d+", "mask"))) == [("ab••••cd••••", True)]
    assert rows(apply_rule(df, Rule.on("c", r"\d+", "mask", "#"))) == [("ab#cd#", True)]


def test_extract_keeps_other_columns_of_an_or_row(people):
    rule = Rule((Predicate("name", "n+"), Predicate("phone", "^9")), "any", "extract")
    assert rows(apply_rule(people, rule)) == [
        ("nn", "012", True), ("Abe", "9", True), ("Bob", "034", False), ("Cy", None, False),
    ]


def test_null_cell_of_a_flagged_row(people):
    preds = (Predicate("name", "^C"), Predicate("phone", "^9"))
    assert rows(apply_rule(people, Rule(preds, "any", "replace", "-")))[3] == ("-y", "", True)
    assert rows(apply_rule(people, Rule(preds, "any", "extract")))[3] == ("C", None, True)


def test_blank_pattern_fills_nulls(people):
    out = apply_rule(people, Rule.on("phone", r"^\s*$", "replace", "0"))
    assert rows(out)[3] == ("Cy", "0", True)


def test_literal_replacement(spark):
    df = spark.createDataFrame([("a1b",)], "c string")
    out = apply_rule(df, Rule.on("c", r"(\d)", "replace", r"$9\1"))
    assert rows(out) == [(r"a$9\1b", True)]
    assert quote_replacement("a$b\\c") == r"a\$b\\c"
    assert quote_replacement("REDACTED") == "REDACTED"


def test_odd_column_names(spark):
    df = spark.createDataFrame([("x1", "y")], "`a.b` string, `c``d` string")
    rule = Rule((Predicate("a.b", r"\d"), Predicate("c`d", "y")), "all", "replace", "z")
    out = apply_rule(df, rule)
    assert out.columns == ["a.b", "c`d", FLAG]
    assert rows(out) == [("xz", "z", True)]


def test_helper_names_stay_out_of_the_way(spark):
    df = spark.createDataFrame([("a", "b")], "`__hit_0` string, x string")
    rule = Rule((Predicate("__hit_0", "z"), Predicate("x", "b")), "any", "extract")
    out = apply_rule(df, rule)
    assert out.columns == ["__hit_0", "x", FLAG] and rows(out) == [("a", "b", True)]


def test_missing_columns_are_all_named(people):
    with pytest.raises(MissingColumnsError) as e:
        apply_rule(people, Rule.fan_out(["x", "name", "y"], "a"))
    assert e.value.missing == ["x", "y"]


def test_flag_name_must_be_free(people):
    with pytest.raises(RuleError):
        apply_rule(people.withColumnRenamed("phone", FLAG), Rule.on("name", "a"))


def test_rule_is_checked():
    with pytest.raises(RuleError):
        Rule(())
    with pytest.raises(RuleError):
        Rule.on("a", "b", "explode")


def test_counts_describe_the_input(spark, people):
    for action, left in [("find", 4), ("keep", 2), ("drop", 2), ("mask", 4)]:
        seen = Observation()
        out = apply_rule(people, Rule.on("name", "^A", action), observe=seen)
        assert len(out.collect()) == left
        assert seen.get == {"total_rows": 4, "matched_rows": 2}
    seen = Observation()
    apply_rule(people.limit(0), Rule.on("name", "^A", "drop"), observe=seen).collect()
    assert seen.get == {"total_rows": 0, "matched_rows": 0}


def test_empty_table_counts(people):
    assert rows(rule_counts(people.limit(0), {"r": Rule.on("name", "A")})) == [("r", 0, 0)]


# ---- plans -------------------------------------------------------------------

ACTIONS = ["find", "replace", "mask", "extract", "keep", "drop"]


@pytest.mark.parametrize("action", ACTIONS)
@pytest.mark.parametrize("combinator", ["all", "any"])
def test_plan_is_map_only_and_native(spark, sf_dir, action, combinator):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    preds = (Predicate("text", "a+b"), Predicate("text", "b+c"), Predicate("lang", "e"))
    text = plan(apply_rule(docs, Rule(preds, combinator, action, "x")))
    for banned in ("Exchange", "Python", "Arrow", "Sort"):
        assert banned not in text


def test_prefix_filter_reaches_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep = apply_rule(docs, Rule.on("lang", "^fr", "keep"))
    assert "StringStartsWith(lang,fr)" in plan(keep)


def test_each_regex_is_evaluated_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    out = apply_rule(docs, Rule((Predicate("text", "q+u"), Predicate("lang", "e+n")), "any", "extract"))
    text = plan(out)
    assert text.count("RLIKE(coalesce(text") == 1 and text.count("RLIKE(coalesce(lang") == 1


# ---- brute force -------------------------------------------------------------


def model(table, columns, rule):
    """The contract in plain Python; only patterns both engines read alike."""
    out = []
    for row in table:
        cells = dict(zip(columns, row))
        hits = [re.search(p.pattern, cells[p.column] or "") is not None for p in rule.predicates]
        flag = all(hits) if rule.combinator == "all" else any(hits)
        if (rule.action == "keep" and not flag) or (rule.action == "drop" and flag):
            continue
        if flag and rule.action in ("replace", "mask", "extract"):
            for p in rule.predicates:
                old = cells[p.column]
                if rule.action == "extract":
                    found = re.search(p.pattern, old or "")
                    cells[p.column] = found.group(0) if found else old
                else:
                    text = rule.value or ("••••" if rule.action == "mask" else "")
                    cells[p.column] = re.sub(p.pattern, lambda m: text, old or "")
        out.append((*cells.values(), flag))
    return out


def test_random_rules_match_the_model(spark):
    rng = random.Random(7)
    columns = ["a", "b", "c"]
    cell = lambda: None if rng.random() < 0.2 else "".join(rng.choices("ab1 ", k=rng.randint(0, 6)))
    table = [tuple(cell() for _ in columns) for _ in range(300)]
    df = spark.createDataFrame(table, "a string, b string, c string").coalesce(1).cache()
    patterns = ["a+", "^a", "^b1", "^a1$", "b$", "[ab]1", r"\d", r"^\s*$", r"^ +", "(?:ab)+", "^.+$", "x"]
    for _ in range(40):
        preds = tuple(
            Predicate(rng.choice(columns), rng.choice(patterns)) for _ in range(rng.randint(1, 4))
        )
        rule = Rule(preds, rng.choice(["all", "any"]), rng.choice(ACTIONS), rng.choice(["", "$1", "Z"]))
        assert rows(apply_rule(df, rule)) == model(table, columns, rule), rule


def test_gates_never_change_the_outcome(spark):
    """Gated entity tests equal the bare patterns on texts built to nearly match."""
    from patternflow.functions.entities import CATALOGUE
    from patternflow.functions.matching import text_matches

    rng = random.Random(3)
    bits = ["1", "23", "456", "7890", "-", ".", ":", "/", "@", "#", "%", "$", "€", "<", ">", " ", "ab", "F",
            "com", "www.", "http", "://", "(", ")", "+", "\t", "\v", "\u00a0", "deadbeef", "cafe", "00:1b", "2024-01-02", ",", "é"]
    texts = [("".join(rng.choices(bits, k=rng.randint(0, 14))),) for _ in range(20_000)]
    df = spark.createDataFrame(texts, "t string")
    wrong = df.agg(
        *(F.count_if(text_matches(F.col("t"), e.pattern) != F.col("t").rlike(e.pattern)).alias(e.name) for e in CATALOGUE),
        *(F.count_if(F.col("t").rlike(e.pattern)).alias(e.name + "_hits") for e in CATALOGUE),
    ).first().asDict()
    assert {e.name: wrong[e.name] for e in CATALOGUE if wrong[e.name]} == {}
    scanned = {r["entity"]: r["matched_rows"] for r in entity_scan(df, ["t"]).collect()}
    assert scanned == {e.name: wrong[e.name + "_hits"] for e in CATALOGUE}
    few = {r["entity"]: r["matched_rows"] for r in entity_scan(df, ["t"], ["letter", "date"]).collect()}
    assert few == {n: scanned[n] for n in ("letter", "date")}
    assert sum(wrong[e.name + "_hits"] > 0 for e in CATALOGUE) >= 20


@pytest.mark.parametrize(
    "entity, yes, no",
    [
        ("ssn", "id 123-45-6789.", "123-456-789"),
        ("zip", "at 90210-1234", "902101"),
        ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456"),
        ("mac_address", "00:1A:2b:3c:4D:5e", "00:1A:2b:3c:4D"),
        ("hex_color", "color #a1B2c3;", "#xyz"),
        ("currency", "€ 1,234.50", "1234"),
        ("date", "on 2024-02-03", "2024-2-3"),
        ("time", "at 12:30:05", "12:3"),
        ("credit_card", "4111 1111 1111 1111", "4111 1111"),
        ("word", "hi", "!?"),
    ],
)
def test_entities_without_hits_in_the_tables(spark, entity, yes, no):
    df = spark.createDataFrame([(yes,), (no,), (None,)], "c string")
    assert rows(entity_scan(df, ["c"], [entity])) == [("c", entity, 3, 1)]


def test_quote_regex_matches_python():
    text = "".join(map(chr, range(1, 128)))
    assert quote_regex(text) == re.escape(text)
