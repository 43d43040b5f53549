"""Checking patterns before they meet the data.

Spark runs patterns on Java's backtracking engine and has no guard of its own.
Every check is a column expression; the compile check
asks the very engine that will run it. Whether a pattern may be slow is read from its form, from its repeated groups, which that engine
tries on short texts, and from a trial of the whole pattern on four texts. Trials count readings and steps and not seconds, so the verdict
is the same on any machine, however busy.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.functions.columns import is_blank, ref
from patternflow.model import COMBINATORS
from patternflow.plans.trial import too_slow

MAX_LENGTH = 2000
# Fixed value: the nested-quantifier shape.
NESTED_QUANTIFIER = r"\([^()]*[*+][^()]*\)[*+]|\([^()]*[*+][^()]*\)\{"

_OPEN, _CLOSE = r"(?<!\\)\((?:\?:)?", r"(?<!\\)\)(?:[*+]|\{\d+,)"
_BEFORE, _AFTER = r"(?:[^()|]*\|)*", r"(?:\|[^()|]*)*"
_ATOM = r"(?:\\[A-Za-z]|\[[^\]\[]+\]|[^\\\[\](){}*+?|^$])"
#: Repeated groups that can read one text in many ways, and repeats that can share one text among them.
AMBIGUOUS = (
    # An alternative that is another one over again, in either order: (a|aa)+, (ab|ab)*
    _OPEN + _BEFORE + r"([^()|]+)\|" + _BEFORE + r"\1+" + _AFTER + _CLOSE,
    _OPEN + _BEFORE + r"([^()|]+)\1*\|" + _BEFORE + r"\1" + _AFTER + _CLOSE,
    # An alternative of one character that another one of one character is a case of: (\w|\d)+, (.|a)*
    _OPEN + _BEFORE + r"(?:\.|\\S)\|" + _BEFORE + r"(?:\\[dwSD]|[^()|\\\s])" + _AFTER + _CLOSE,
    _OPEN + _BEFORE + r"(?:\\[dwSD]|[^()|\\\s])\|" + _BEFORE + r"(?:\.|\\S)" + _AFTER + _CLOSE,
    _OPEN + _BEFORE + r"\\w\|" + _BEFORE + r"(?:\\d|[A-Za-z0-9_])" + _AFTER + _CLOSE,
    _OPEN + _BEFORE + r"(?:\\d|[A-Za-z0-9_])\|" + _BEFORE + r"\\w" + _AFTER + _CLOSE,
    # The same character repeated without bound four times on end: a*a*a*a*
    "(" + _ATOM + r")[*+]\??(?:\1[*+]\??){3}",
)

#: The body of a repeated group without groups in it, if the pattern goes on behind it and so may fail there.
_REPEATED = r"(?s)(?<!\\)\((?:\?:|\?<[A-Za-z]\w*>)?((?!\?)[^()]*)(?<!\\)\)(?:[*+]|\{\d+,\d*\})\??(?!\+)(?=.)"
#: Texts that groups are tried on, besides their own alternatives of up to so many characters.
_TRIAL_CHARACTERS = [*"abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 \t\n.,;:_-/@#+"]
_TRIAL_TEXTS = ["aa", "ab", "ba", "aba", "aA", "a0", "0a", "00", "0a0", "a a", "  ", " a", "a ", "a-", "-a", "a.", "0.", "0 0", "0-0", "--", "a,a", "a_a"]
_LONGEST_TRIAL = 12

EMPTY = "Empty pattern."
TOO_LONG = f"Pattern is longer than {MAX_LENGTH} characters."
INVALID = "Invalid regex."
NESTED = "Nested unbounded quantifiers risk catastrophic backtracking."
SLOW = "Too slow on short texts; catastrophic backtracking is likely."


def check_pattern(pattern: str | None) -> str | None:
    """Why a pattern must not run, or None if it may."""
    if pattern is None or not pattern.strip():
        return EMPTY
    if len(pattern) > MAX_LENGTH:
        return TOO_LONG
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (PySparkException, Py4JError):
        return INVALID
    if re.search(NESTED_QUANTIFIER, pattern):
        return NESTED
    one = spark.sql("SELECT 1").select(F.array(F.lit(pattern)).alias("patterns"))
    if one.select(ambiguous(F.get("patterns", F.lit(0)))).first()[0]:
        return SLOW
    return SLOW if re.search(r"[*+?{|]", pattern) and one.select(too_slow("patterns")).first()[0][0] else None


def compiles(pattern: Column) -> Column:
    """Whether Java's engine takes the pattern."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def ambiguous(pattern: Column) -> Column:
    """Whether the pattern has a repeat that is likely to backtrack without end."""
    repeats = pattern.rlike(r"[*+{]")
    shapes = reduce(or_, (pattern.rlike(shape) for shape in AMBIGUOUS))
    return repeats & (shapes | (pattern.contains(")") & read_in_two_ways(pattern)))


def read_in_two_ways(pattern: Column) -> Column:
    """Whether a repeated group reads one of the trial texts in more than one way.

    Either two of its alternatives read the text, or rounds of the group do after a first round of either of two lengths. Then a run of such
    texts can be read in a number of ways that doubles with each, all of which are gone through if what follows fails.
    """

    def reads(regex: Column, text: Column) -> Column:
        return F.regexp_like(text, F.concat(F.lit(r"\A(?:"), regex, F.lit(r")\z")))

    def two_alternatives(alternatives: Column, texts: Column) -> Column:
        apart = (F.size(alternatives) > 1) & F.forall(alternatives, lambda a: compiles(F.concat(F.lit("(?:"), a, F.lit(")"))))
        return apart & F.exists(texts, lambda text: F.size(F.filter(alternatives, lambda a: reads(a, text))) > 1)

    def two_lengths(body: Column, texts: Column) -> Column:
        rounds = F.concat(F.lit("(?:"), body, F.lit(")*"))

        def firsts(text: Column) -> Column:
            return F.filter(
                F.sequence(F.lit(1), F.length(text)),
                lambda n: reads(body, F.substring(text, F.lit(1), n)) & reads(rounds, F.substring(text, n + 1, F.length(text))),
            )

        return F.exists(texts, lambda text: F.size(firsts(text)) > 1)

    def tried(body: Column) -> Column:
        alternatives = F.split(body, r"\|", -1)
        own = F.filter(alternatives, lambda a: F.length(a).between(1, _LONGEST_TRIAL))
        longer, texts = F.concat(F.array(*map(F.lit, _TRIAL_TEXTS)), own), F.array(*map(F.lit, _TRIAL_CHARACTERS))
        sound = compiles(F.concat(F.lit("(?:"), body, F.lit(")*")))
        return F.when(sound, two_alternatives(alternatives, F.concat(texts, longer)) | two_lengths(body, longer)).otherwise(False)

    return F.exists(F.regexp_extract_all(pattern, F.lit(_REPEATED), 1), tried)


def full_reason(pattern: Column) -> Column:
    """The static checks, the compile check and the check for ambiguity; null when they pass."""
    static = static_reason(pattern)
    return (
        F.when(static.isNotNull() & (static != NESTED), static)
        .when(~compiles(pattern), INVALID)
        .when(static.isNotNull(), static)
        .when(ambiguous(pattern), SLOW)
    )


def _with_reasons(rules: DataFrame, patterns: Column, trial: bool) -> DataFrame:
    """Add ``__reasons``, the reason of each of an array of patterns. Only those that pass so far are tried."""
    if not trial:
        return rules.withColumn("__reasons", F.transform(patterns, static_reason))
    rules = rules.withColumn("__formal", F.transform(patterns, full_reason))
    rules = rules.withColumn("__tried", F.zip_with(patterns, "__formal", lambda p, why: F.when(why.isNull(), p)))
    reasons = F.zip_with("__formal", too_slow("__tried"), lambda why, slow: F.coalesce(why, F.when(slow, SLOW)))
    return rules.withColumn("__reasons", reasons).drop("__formal", "__tried")


def static_reason(pattern: Column) -> Column:
    """The checks that need no regex engine; null when they pass."""
    return (
        F.when(pattern.isNull() | is_blank(pattern), EMPTY)
        .when(F.length(pattern) > MAX_LENGTH, TOO_LONG)
        .when(pattern.contains(")") & pattern.rlike(NESTED_QUANTIFIER), NESTED)
    )


def lint_rules(rules: DataFrame, pattern: str = "pattern", *, trial: bool = True) -> DataFrame:
    """Add ``ok`` and ``reason`` to a table of patterns.

    ``trial=False`` keeps to the static checks: neither compiled nor looked at for ambiguity, nor tried.
    """
    p = ref(pattern)
    if trial:
        rules = _with_reasons(rules, F.array(p), trial)
        rules = rules.withColumn("reason", F.get("__reasons", F.lit(0))).drop("__reasons")
    else:
        rules = rules.withColumn("reason", static_reason(p))
    return rules.withColumn("ok", F.col("reason").isNull())


def validate_rules(
    rules: DataFrame,
    *,
    predicates: str = "predicates",
    columns: str = "columns",
    combinator: str = "combinator",
    trial: bool = True,
) -> DataFrame:
    """Check resolved rules: add ``error`` (null if fine) and normalise the combinator.

    A rule needs a predicate, every predicate's column has to be a target column
    and every pattern has to pass the checks; the first fault in list order counts.
    """
    preds = ref(predicates)
    patterns = F.transform(preds, lambda p: p["pattern"])
    faults = F.zip_with(
        preds,
        F.col("__reasons"),
        lambda p, why: F.when(
            ~F.coalesce(F.array_contains(ref(columns), p["column"]), F.lit(False)),
            F.concat(F.lit("Not a target column: "), F.coalesce(p["column"], F.lit(""))),
        ).otherwise(why),
    )
    first = F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0))
    empty = F.coalesce(F.size(preds), F.lit(0)) <= 0
    return (
        _with_reasons(rules, patterns, trial)
        .withColumn("error", F.when(empty, "No match condition.").otherwise(first))
        .withColumn(
            combinator, F.when(ref(combinator).isin(*COMBINATORS), ref(combinator)).otherwise("all")
        )
        .drop("__reasons")
    )
