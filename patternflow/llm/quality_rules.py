"""Quality rules whose thresholds carry a statistical guarantee.

Base rules are fixed. The method adds rules on text statistics, each with a
fixed grid of cutoffs. In every stratum (language by default) labelled good
documents are the holdout, one row for each identifier: that the rules of a stratum together reject more than ``alpha`` of its good
documents is ruled out at level ``delta`` over all strata together. Rules are added in
their order. A rule's cutoff is tested on the union, the good documents rejected by it or by a rule chosen before; it
passes when the exact binomial probability of seeing as few false rejections as were seen,
were their true rate ``alpha``, is at most ``delta / tests`` (Bonferroni), where the
tests are all unions that any outcome could lead to, in all strata. That is
the same as a Clopper-Pearson upper bound of at most ``alpha``. Each rule takes the
tightest cutoff that passes together with all looser ones; a rule none of whose
cutoffs pass stays off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternflow.llm.common import SPACES, count_words, narrowed, ref, staged, whole_text, words

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
#: Largest share of a stratum's good documents that all rules together may reject, and the chance of any stratum breaking that.
ALPHA = 0.01
DELTA = 0.05
#: The rules, as per mille of a document's own total: rejected at or above the cutoff, loosest first.
CUTOFFS = {
    "symbol_permille": (800, 400, 200, 100, 50, 30),
    "dup_line_permille": (900, 700, 500, 300, 200),
    "repeat_permille": (900, 700, 500, 300, 200, 100),
    "shout_permille": (900, 700, 500, 300, 200),
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: tuple[str, ...]) -> Column:
    for ch in characters:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _repeated(pairs: Column) -> Column:
    """Words inside windows found twice or more, from the sorted (window, place) pairs.

    Equal windows are neighbours. The places of repeated ones, back in order, are
    merged into stretches of words. ``pairs`` must be a plain column: a computed
    array would be computed again for every element.
    """
    last = F.size(pairs) - 1

    def met(pair: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(pairs, k - 1)["h"] == pair["h"])
        after = F.when(k < last, F.get(pairs, k + 1)["h"] == pair["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    places = F.array_sort(F.transform(F.filter(pairs, met), lambda p: p["i"]))
    start = F.struct(F.lit(0).alias("count"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda s, i: F.struct(
            (s["count"] + i + WINDOW - F.greatest(s["end"], i)).alias("count"), (i + WINDOW).alias("end")
        ),
        lambda s: s["count"],
    )


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts named in ``STATISTICS``, n_lines and n_shout, as long.

    Null and empty texts have zero everywhere. Windows are told apart by a
    64-bit hash within their own document.
    """
    text = whole_text(text_col)
    split = df.withColumn("_words", words(text)).withColumn(
        "_windows",
        F.when(
            F.size("_words") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]),
            ),
        ),
    )
    any_repeat = F.size(F.array_distinct("_windows")) < F.size("_windows")
    paired = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    split = split.withColumn("_pairs", F.when(any_repeat, F.array_sort(paired)))
    lines = F.filter(F.split(text, "\n"), lambda line: count_words(line) > 0)
    out = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(_without(text, SPACES)).cast("long"),
            "n_symbols": (
                F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
            ).cast("long"),
            "_lines": lines,
            "n_repeat_words": F.coalesce(_repeated(F.col("_pairs")), F.lit(0)).cast("long"),
            "n_shout": F.regexp_count(text, F.lit(r"[A-Z]{2}")).cast("long"),
        }
    ).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return out.withColumn("n_lines", F.size("_lines").cast("long")).drop("_words", "_windows", "_pairs", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def _measures() -> dict[str, Column]:
    """Each rule's measure as a whole number, so that engines agree on every comparison."""

    def permille(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("long")

    return {
        "symbol_permille": permille(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_permille": permille(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_permille": permille(F.col("n_repeat_words"), F.col("n_words")),
        "shout_permille": permille(2 * F.col("n_shout"), F.col("word_chars")),
    }


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series ten places further on."""
    x = n.cast("double") + 11
    steps = F.lit(0.0)
    for i in range(1, 11):
        steps = steps + F.log(n + i)
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - steps


def _binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n * p; at least one half elsewhere, given as 1.

    Terms are summed from k down. The j-th is at most exp(-j * j / (2 * n * p)) of the first, so
    9 * sqrt(n * p) of them, and a few more for small numbers, leave out nothing that a double holds.
    """
    n_p = n * F.lit(p)
    first = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.lit(math.log(p)) + (n - k) * F.lit(math.log1p(-p))
    )
    last = F.greatest(F.lit(1), k - F.ceil(9 * F.sqrt(n_p)).cast("long") - 60).cast("long")
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n - i + 1) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    downwards = F.when(k >= 1, F.sequence(k, last, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n_p, F.lit(1.0)).otherwise(F.aggregate(downwards, start, add, lambda s: s["total"]))


def possible_unions(cutoffs: dict[str, tuple[int, ...]]) -> int:
    """How many unions of a stratum could come to a test, whatever the outcomes before."""
    total, before = 0, 1
    for grid in cutoffs.values():
        total += before * len(grid)
        before *= len(grid) + 1
    return total


def select_cutoffs(
    holdout: DataFrame,
    stratum: str,
    *,
    cutoffs: dict[str, tuple[int, ...]] = CUTOFFS,
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """One row per stratum: stratum, and for each rule ``cut_<rule>``, the tightest cutoff it may use there, null for none.

    ``holdout`` holds good documents with one column per rule. They are counted by
    stratum and the number of each rule's cutoffs that reject them before anything moves, which
    makes at most the product of (cutoffs + 1) rows a stratum whatever the input's size.
    """
    hits = [sum((ref(rule) >= c).cast("int") for c in grid).alias(f"hits_{rule}") for rule, grid in cutoffs.items()]
    cells = staged(
        holdout.select(ref(stratum).alias("stratum"), *hits)
        .groupBy("stratum", *[f"hits_{rule}" for rule in cutoffs])
        .agg(F.count(F.lit(1)).alias("n")),
        "quality-cells",
    )
    level = delta / max(1, cells.select("stratum").distinct().count() * possible_unions(cutoffs))
    whole = Window.partitionBy("stratum")
    cells = cells.withColumns({"good": F.sum("n").over(whole), "hit": F.lit(False)})
    for rule, grid in cutoffs.items():
        # Cutoffs run from loose to tight: a document that h of them reject is rejected by the last h.
        tests = [
            F.sum(F.when(F.col("hit") | (F.col(f"hits_{rule}") + step >= len(grid)), F.col("n")).otherwise(0)).over(whole)
            for step in range(len(grid))
        ]
        cells = cells.withColumn("rejected", F.array(*tests))
        passes = F.transform("rejected", lambda k: _binomial_below(k, F.col("good"), alpha) <= F.lit(level))
        # The number of cutoffs before the first that fails.
        passed = F.array_position(F.concat(passes, F.array(F.lit(False))), False).cast("int") - 1
        cells = cells.withColumn(f"passed_{rule}", passed).withColumn(
            "hit", F.col("hit") | (F.col(f"hits_{rule}") + F.col(f"passed_{rule}") > len(grid))
        )
    return cells.groupBy("stratum").agg(
        *[
            F.get(F.array(*map(F.lit, grid)), F.max(f"passed_{rule}") - 1).alias(f"cut_{rule}")
            for rule, grid in cutoffs.items()
        ]
    )


def judge(
    df: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    *,
    label_col: str = "quality",
    cutoffs: dict[str, tuple[int, ...]] = CUTOFFS,
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """One row per input row: identifier, ``STATISTICS``, base_failed, kept, failed_rules.

    ``labelled`` has the identifier and ``label_col`` (1 for good; where labels of one
    identifier differ the lowest holds; of rows that share an identifier the one with the least stratum
    and statistics is in the holdout). A null stratum is a stratum of its own. Null and
    empty texts fail the base. Without labels, or in a stratum with too few, the method
    rejects nothing. ``failed_rules`` names the rules that reject, in order, joined by
    commas. Other columns of the input are ignored.
    """
    stratum = F.coalesce(ref(stratum_col).cast("string"), F.lit("")).alias("stratum")
    rows = df.select(ref(id_col).alias("id"), ref(text_col).alias("text"), stratum)
    counted = text_statistics(rows).select("id", "stratum", *STATISTICS, "n_lines", "n_shout")
    measured = staged(counted.withColumns(_measures()).withColumn("base_failed", base_failed()), "quality-statistics")

    good = (
        narrowed(labelled, id_col, label_col)
        .groupBy(ref(id_col).alias("id"))
        .agg(F.min(ref(label_col)).alias("label"))
        .filter("label = 1")
    )
    # One row of an identifier: rows that repeat it are no independent trials.
    labelled_rows = measured.join(good, "id", "left_semi").groupBy("id").agg(F.min(F.struct("stratum", *cutoffs)).alias("row"))
    chosen = select_cutoffs(labelled_rows.select("row.*"), "stratum", cutoffs=cutoffs, alpha=alpha, delta=delta)
    # Written, so that its true size decides whether the join below broadcasts it.
    table = staged(chosen, "quality-cutoffs")
    fails = F.array_compact(
        F.array(*[F.when(ref(r) >= ref(f"cut_{r}"), F.lit(r)) for r in cutoffs])
    )
    return (
        measured.join(table, "stratum", "left")
        .withColumn("fails", fails)
        .select(
            F.col("id").alias(id_col),
            *STATISTICS,
            "base_failed",
            (~F.col("base_failed") & (F.size("fails") == 0)).alias("kept"),
            F.array_join("fails", ",").alias("failed_rules"),
        )
    )
