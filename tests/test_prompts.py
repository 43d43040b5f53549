import pytest
from pyspark.sql import functions as F

from patternflow import BY_NAME, RuleError, check_pattern, pattern_of, resolve_prompts, rule_from_prompt
from patternflow.plans import prompts as R


def resolve(spark, prompts, columns=("col",)):
    df = spark.createDataFrame([(p, list(columns)) for p in prompts], "prompt string, columns array<string>")
    found = {r["prompt"]: r for r in resolve_prompts(df).collect()}
    return [found[p] for p in prompts]


def test_patterns(spark):
    cases = {
        "Find email addresses in the Email column": pattern_of("email"),
        "redact phone numbers": pattern_of("phone"),
        "replace the word 'cat'": r"\bcat\b",
        "rows where name starts with 'Dr'": "^Dr",
        "names ending with 'son'": "son$",
        "rows where status is exactly 'Yes'": "^Yes$",
        "find \"a.b (c)\"": r"\ba\.b\ \(c\)\b",
        "redact e-mail addresses": pattern_of("email"),
        "strip percentages": pattern_of("percent"),
        "find numbers": pattern_of("number"),
        "extract uuids": pattern_of("uuid"),
        "remove extra whitespace": pattern_of("whitespace"),
        "find hex color codes": pattern_of("hex_color"),
        "match the timestamp": pattern_of("time"),
        "empty cell": pattern_of("phone"),
        "costs in €": pattern_of("currency"),
    }
    got = resolve(spark, list(cases))
    assert [r["predicates"][0]["pattern"] for r in got] == list(cases.values())
    assert all(r["error"] is None and r["source"] == "heuristic" for r in got)


def test_nothing_known(spark):
    prompts = ["do something clever to the data zzz", "update the contact info", "the recipient list"]
    for r in resolve(spark, prompts):
        assert r["predicates"] is None and r["error"] == R.NOT_DERIVED


def test_no_columns(spark):
    assert resolve(spark, ["find emails"], [])[0]["error"] == R.NO_COLUMNS


def test_fan_out(spark):
    r = resolve(spark, ["find email addresses"], ["Work", "Personal"])[0]
    assert r["combinator"] == "any"
    assert [p["column"] for p in r["predicates"]] == ["Work", "Personal"]
    assert r["explanation"] == BY_NAME["email"].explanation


ACTIONS = {
    "redact credit card numbers": "mask",
    "mask the phone numbers": "mask",
    "obscure email addresses": "mask",
    "extract email addresses": "extract",
    "pull out the dates": "extract",
    "keep only rows where email contains example": "keep",
    "filter to rows with a phone number": "keep",
    "drop rows where the email is empty": "drop",
    "delete rows with test emails": "drop",
    "remove email addresses": "replace",
    "find phone numbers": "find",
    "show rows where email is empty": "find",
    "highlight the dates": "find",
    "find and replace emails with X": "replace",
    "email addresses": "replace",
}


def test_actions(spark):
    df = spark.createDataFrame([(p,) for p in ACTIONS], "prompt string")
    got = df.select("prompt", R.infer_action(F.col("prompt")).alias("a")).collect()
    assert {r["prompt"]: r["a"] for r in got} == ACTIONS


def test_inline_value(spark):
    got = resolve(spark, ["replace phone numbers with N/A", "swap emails with  the 'new one' ", "redact the email addresses"])
    assert [(r["action"], r["value"]) for r in got] == [("replace", "N/A"), ("replace", "new one"), ("mask", "")]


@pytest.mark.parametrize(
    "requested, typed, inferred, value, want",
    [
        ("mask", "•", "keep", "ignored", ("mask", "•")),
        ("auto", "", "extract", "", ("extract", "")),
        ("auto", "", None, "", ("replace", "")),
        ("auto", "TYPED", "replace", "inferred", ("replace", "TYPED")),
        ("auto", "", "replace", "REDACTED", ("replace", "REDACTED")),
        ("auto", "", "nonsense", "", ("replace", "")),
    ],
)
def test_action_resolution(spark, requested, typed, inferred, value, want):
    a, v = R.resolve_action(F.lit(requested), F.lit(typed), F.lit(inferred).cast("string"), F.lit(value))
    assert tuple(spark.range(1).select(a, v).first()) == want


def test_single_request(spark):
    rule = rule_from_prompt(spark, "mask the phone numbers", ["a"], value="#")
    assert (rule.action, rule.value, rule.predicates[0].column) == ("mask", "#", "a")
    assert check_pattern(rule.predicates[0].pattern) is None
    with pytest.raises(RuleError):
        rule_from_prompt(spark, "zzz", ["a"])


def test_summary(spark):
    preds = "array(named_struct('column','Name','pattern','^A'), named_struct('column','phone','pattern','^0'))"
    df = spark.range(1).select(
        R.rule_summary(F.expr(preds), F.lit("all")),
        R.rule_summary(F.expr(preds), F.lit("any")),
        R.rule_summary(F.expr(f"slice({preds}, 1, 1)"), F.lit("all")),
        R.rule_summary(F.expr(f"slice({preds}, 1, 0)"), F.lit("all")),
    )
    assert tuple(df.first()) == ("Name ~ /^A/ AND phone ~ /^0/", "Name ~ /^A/ OR phone ~ /^0/", "^A", "")


def test_resolution_is_map_only(spark, sf_dir):
    from tests.conftest import plan

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    df = turns.select(F.col("text").alias("prompt"), F.array(F.lit("x")).alias("columns"))
    text = plan(resolve_prompts(df))
    assert "Exchange" not in text and "Python" not in text


def test_longest_keyword_never_hides_an_earlier_entity():
    for a, at in R._PLACE.items():
        for b, other in R._PLACE.items():
            if b.startswith(a):
                assert other <= at, (a, b)


def test_keyword_search_against_brute_force(spark):
    import random
    import re

    from patternflow.functions.entities import CATALOGUE

    rng = random.Random(2)
    words = [k for e in CATALOGUE for k in e.keywords] + ["x", "s", " ", "-", " ", "é", "update", "alpha", "tag"]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", R.named_entity(F.col("t")).alias("p")).collect()}

    def named(text, keyword):
        if not keyword[0].isalnum():
            return keyword in text
        return re.search("(?<![a-z0-9])" + re.escape(keyword), text) is not None

    for t in texts:
        want = next((i for i, e in enumerate(CATALOGUE) if any(named(t, k) for k in e.keywords)), None)
        assert got[t] == want, t
