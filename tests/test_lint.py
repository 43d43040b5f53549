import pytest
from pyspark.sql import functions as F

from patternflow import CATALOGUE, check_pattern, lint_rules, validate_rules
from patternflow.plans import lint as L

pytestmark = pytest.mark.usefixtures("spark")  # patterns are compiled by the session's own engine


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b", None),
        ("([a-z]+", L.INVALID),
        ("", L.EMPTY),
        ("   ", L.EMPTY),
        (None, L.EMPTY),
        ("(a+)+$", L.NESTED),
        ("(a+){2}", L.NESTED),
        ("a" * 5000, L.TOO_LONG),
        (r"\p{L}+\p{Digit}*", None),
        (r"\P{Lu}[\p{L}\d]", None),
        (r"(?<word>\w+)\k<word>", None),
        (r"\b\d++\b", None),
        (r"(?>a|b)\h\R", None),
        (r"\\h", None),
        (r"^(a|aa)+$", L.SLOW),
    ],
)
def test_verdicts(pattern, want):
    assert check_pattern(pattern) == want


def test_catalogue_is_safe():
    assert [e.name for e in CATALOGUE if check_pattern(e.pattern)] == []


def test_table_of_patterns(spark):
    df = spark.createDataFrame([(1, "a+"), (2, "(a+)+"), (3, None), (4, "[")], "id int, pattern string")
    got = {r["id"]: (r["ok"], r["reason"]) for r in lint_rules(df).collect()}
    assert got == {1: (True, None), 2: (False, L.NESTED), 3: (False, L.EMPTY), 4: (False, L.INVALID)}
    static = {r["id"]: r["ok"] for r in lint_rules(df, trial=False).collect()}
    assert static == {1: True, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("trial", [True, False])
def test_rules_table(spark, trial):
    data = [
        (1, [("a", "x")], ["a"], "any"),
        (2, [("a", "x"), ("z", "(a+)+")], ["a"], "none"),
        (3, [("a", "(a+)+"), ("z", "x")], ["a"], "all"),
        (4, [], ["a"], "all"),
        (5, None, ["a"], None),
    ]
    schema = "id int, predicates array<struct<column:string,pattern:string>>, columns array<string>, combinator string"
    out = validate_rules(spark.createDataFrame(data, schema), trial=trial)
    got = {r["id"]: (r["combinator"], r["error"]) for r in out.collect()}
    assert got == {
        1: ("any", None),
        2: ("all", "Not a target column: z"),
        3: ("all", L.NESTED),
        4: ("all", "No match condition."),
        5: ("all", "No match condition."),
    }


SLOW = [
    r"(b|bb)+$", r"^(?:x|ab|abab)*$", r"(aa|a){2,}$", r"(ab|ab)*c", r"(\w|\d)+$", r"(.|a)*b", r"(\d|\w)+-", r"(?:\S|x)+$",
    r"a*a*a*a*b", r"\d+\d+\d+\d+x", r"[a-z]*[a-z]*[a-z]*[a-z]*!",
]
FINE = [
    r"(cat|car)+", r"(a|ab)+", r"(jan|jun|jul)+", r"(a|aa)", r"\(a|aa\)+", r"(?:\d[ -]?){13,16}", r"\d{4}-\d{2}", r"(\w|-)+", r"(?:\s|x)*",
    r"a+b+a+b+", r"[a|aa]+", r"(foo|bar)?", r".*x.*y.*", r"(\d|[A-F])+",
]


def test_ambiguity_is_read_from_the_form(spark):
    """The verdict of both entry points, with no Python worker and no clock."""
    from tests.conftest import plan

    assert [p for p in SLOW if check_pattern(p) != L.SLOW] == []
    assert [p for p in FINE if check_pattern(p) is not None] == []
    linted = lint_rules(spark.createDataFrame([(p,) for p in SLOW + FINE], "pattern string"))
    assert {r["pattern"]: r["reason"] for r in linted.collect()} == {**dict.fromkeys(SLOW, L.SLOW), **dict.fromkeys(FINE)}
    text = plan(linted)
    assert "Python" not in text and "Exchange" not in text


#: Patterns whose form tells nothing, but which read some short text in two ways.
TRIED_SLOW = [
    r"(a|b|ab)+$", r"(a|a?)+$", r"([a-z]|[a-c])*!", r"(\d|[0-9])+x", r"(a{1,3})+$", r"(?:a?b?)+c", r"(foo|bar|foobar)*$", r"(.|\s)*!",
    r"(?<w>a|b|ba)+$", r"(a|b|ab){2,}c",
]
TRIED_FINE = [
    r"(a{1,3})+", r"(a|b|ab)++c", r"(\d{1,3},)*\d{1,3}$", r"(a|b|c)+$", r"([a|b]c)+d", r"(a\)|b)+c", r"((?:ab|cd)x)+y", r"(foo|bar)*$",
    r"(?:\d[ -]?){13,16}x",
]


def test_repeated_groups_are_tried_on_short_texts(spark):
    """Both entry points, with no Python worker and no clock."""
    from tests.conftest import plan

    linted = lint_rules(spark.createDataFrame([(p,) for p in TRIED_SLOW + TRIED_FINE], "pattern string"))
    assert {r["pattern"]: r["reason"] for r in linted.collect()} == {**dict.fromkeys(TRIED_SLOW, L.SLOW), **dict.fromkeys(TRIED_FINE)}
    assert [check_pattern(p) for p in (TRIED_SLOW[0], TRIED_FINE[1])] == [L.SLOW, None]
    assert "Python" not in plan(linted) and "Exchange" not in plan(linted)


#: Patterns that a search of one of the four trial texts does not come to an end with in good time, though no group alone reads in two ways.
TRIAL_SLOW = [
    r"((a+)b?)+$", r"((a|b)|ab)+$", r"(x?(a|a))+$", r"([ab]?a?b)+x", r"(a?){30}$", "a?" * 25 + "$", "(a|a)" * 25 + "$", r"(?:(?:\w\w?)\d*)+-",
    r"((\d|x)+,?)+$", r"a*[a-b]*\w*.*\S*[^!]*[a-z]*X", r"(?=((a)|b|ab)+x)a", r"(?:((a|b)|ab)+#|\w)+", r"(?i)((A|B)|AB)+#", r"(\s{2,}|\t)*0",
]
TRIAL_FINE = [
    r"((a+)b?)+", r"((a|b)|c)+$", r"(x?(a|b))+$", r"((a|b)|ab)++c", r"(a?){4}$", r"\((a|b)\)+c", r"((?:ab|cd)+x)+y", r"(?>(a|b)|ab)x", r"\w+\d?\w+x?\w+#",
    r"^(?=.*\d)(?=.*[a-z])(?=.*[A-Z]).{8,}$", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)", r"[|?*]+\Q(a|b\E$",
]


def test_patterns_are_tried_on_the_trial_texts(spark):
    """Whole patterns, with groups in groups, counted repeats and repeats that share a text; a search that finds something ends there."""
    from tests.conftest import plan

    patterns = TRIAL_SLOW + TRIAL_FINE
    want = {**dict.fromkeys(TRIAL_SLOW, L.SLOW), **dict.fromkeys(TRIAL_FINE)}
    linted = lint_rules(spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert {r["pattern"]: r["reason"] for r in linted.collect()} == want
    assert linted.columns == ["pattern", "reason", "ok"]
    assert "Python" not in plan(linted) and "Exchange" not in plan(linted)
    rules = spark.createDataFrame([([("a", p)], ["a"], "all") for p in patterns], "predicates array<struct<column:string,pattern:string>>, columns array<string>, combinator string")
    checked = validate_rules(rules)
    assert {r["predicates"][0]["pattern"]: r["error"] for r in checked.collect()} == want
    assert checked.columns == ["predicates", "columns", "combinator", "error"]
    assert [check_pattern(p) for p in (TRIAL_SLOW[0], TRIAL_FINE[0])] == [L.SLOW, None]


def test_slow_patterns_are_named_as_in_the_trial():
    """The reason that the SQL of `lint_trial` has had from the first."""
    from checks import ORACLES

    assert "Too slow on short texts; catastrophic backtracking is likely." in ORACLES["lint_trial"]


JAVA_ONLY = [r"\Qa.b\E", r"\pL+", r"a\z", r"\x{41}", r"(?U)\w+", r"(?<=a{1,3})b", r"\G\d"]
PYTHON_ONLY = [r"(?P<n>a)", r"a{,3}", r"(?a)x"]


def test_the_engine_that_runs_patterns_judges_them(spark):
    assert [p for p in JAVA_ONLY if check_pattern(p) is not None] == []
    assert [p for p in PYTHON_ONLY if check_pattern(p) != L.INVALID] == []
    df = spark.createDataFrame([(p,) for p in JAVA_ONLY + PYTHON_ONLY], "pattern string")
    got = {r["pattern"]: r["reason"] for r in lint_rules(df).collect()}
    assert got == {**dict.fromkeys(JAVA_ONLY), **dict.fromkeys(PYTHON_ONLY, L.INVALID)}
