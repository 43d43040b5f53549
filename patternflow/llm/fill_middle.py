"""Fill-in-middle transformation: a text cut in three at random units, its middle moved to the end.

``regexp_count`` gives a text's number of units. The two cuts then make a pattern of the text's own,
``(unit{a})(unit{b-a})(rest)`` with counted possessive quantifiers, and a single match of it captures prefix, middle
and suffix; the replacement puts them between the sentinels. Possessive counts are matched in a loop,
not by recursion, so a text of millions of units needs no more stack than a short one.

All of it is column expressions in a map-only plan. Draws depend on the seed and the identifier alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ref, whole_text

#: A word with the white space before it; white space that no word follows is a unit of its own.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SEED = 42
#: Of a hundred texts those that are rearranged, and of a hundred of them those that start with the suffix.
RATE, SUFFIX_FIRST = 50, 80
PLAIN, PREFIX_FIRST_FORM, SUFFIX_FIRST_FORM = "plain", "psm", "spm"
#: What the operator adds to the rows.
ADDED = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Sentinels:
    """The marks before prefix, suffix and middle.

    A mark's first character is in no mark at another place, and no mark starts with another one. Then no piece
    of text beside a mark can form one with it, and the marks of an output are found where they were put.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all
        heads = {m[:1] for m in marks}
        clash = any(a != b and a.startswith(b) for a in marks for b in marks)
        if len(set(marks)) < 3 or "" in marks or clash or any(h in m[1:] for h in heads for m in marks):
            raise ValueError(f"Sentinels {marks} could not be told apart in an output")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(m) for m in self.all)


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and identifier; a null identifier reads as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(ref(id_col).cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def count_units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def _template(marks: Sentinels, form: Column) -> Column:
    """The replacement that puts the three captured pieces in the form's order."""
    p, s, m = (re.sub(r"([\\$])", r"\\\1", mark) for mark in marks.all)
    return F.when(form == SUFFIX_FIRST_FORM, F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))


def rearrange(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    sentinels: Sentinels = Sentinels(),
) -> DataFrame:
    """One row per input row: identifier, n, form, prefix, middle, suffix, output.

    ``n`` counts the text's units. The prefix ends after the smaller of two drawn numbers of units, the middle after
    the larger; either may be empty. Form ``psm`` writes prefix, suffix, middle, each behind its sentinel, form
    ``spm`` suffix, prefix, middle. Form ``plain`` leaves the text as it is: where it is empty or holds a sentinel,
    and where the draw falls outside ``rate`` per cent; prefix, middle and suffix are null there. Null texts
    count as empty. Rows that share an identifier share its draws. Texts of any length are cut whole. Other
    columns are ignored, whatever their names; an empty table gives none.
    """
    h1, h2, h3, h4 = (F.col(f"h{i}") for i in range(1, 5))
    drawn = df.select(ref(id_col).alias("id"), whole_text(ref(text_col).cast("string")).alias("body")).select(
        "id", "body", count_units(F.col("body")).alias("n"), *(h.alias(f"h{i + 1}") for i, h in enumerate(draws("id", seed)))
    )
    plain = (F.col("body") == "") | F.col("body").rlike(sentinels.pattern) | (h3 % 100 >= rate)
    form = F.when(plain, PLAIN).when(h4 % 100 < suffix_first, SUFFIX_FIRST_FORM).otherwise(PREFIX_FIRST_FORM)
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    placed = drawn.select("id", "body", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))

    def group(count: Column) -> Column:
        return F.concat(F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)"))

    own = F.concat(F.lit(r"(?s)\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"(.*+)\z"))
    moved = placed.select(
        "id", "n", "form",
        F.when(F.col("form") == PLAIN, F.col("body"))
        .otherwise(F.regexp_replace("body", own, _template(sentinels, F.col("form"))))
        .alias("output"),
    )
    cut = moved.select("*", pieces(F.col("output"), F.col("form"), sentinels).alias("cut"))
    return cut.select(F.col("id").alias(id_col), "n", "form", "cut.prefix", "cut.middle", "cut.suffix", "output")


def pieces(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """prefix, middle and suffix of an output, from nothing but it and its form; null in a plain one."""
    part = F.split(output, sentinels.pattern)
    suffix_first = form == SUFFIX_FIRST_FORM

    def at(i: int) -> Column:
        return F.get(part, i)

    return F.when(
        form != PLAIN,
        F.struct(
            F.when(suffix_first, at(2)).otherwise(at(1)).alias("prefix"),
            at(3).alias("middle"),
            F.when(suffix_first, at(1)).otherwise(at(2)).alias("suffix"),
        ),
    )


def restored(df: DataFrame, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` and ``form`` of ``df`` were made from."""
    cut = pieces(df["output"], df["form"], sentinels)
    return F.when(df["form"] == PLAIN, df["output"]).otherwise(F.concat(cut["prefix"], cut["middle"], cut["suffix"]))
