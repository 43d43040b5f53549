"""Fill-in-middle against plain Python."""

import hashlib
import re

import pytest

from patternflow.llm import fill_middle
from patternflow.llm.fill_middle import Sentinels

from .conftest import LONG, ROWS, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, seed=42, rate=50, suffix_first=80, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return len(units), "spm", prefix, middle, suffix, s + suffix + p + prefix + m + middle
    return len(units), "psm", prefix, middle, suffix, p + prefix + s + suffix + m + middle


def held(df, rows, **options):
    moved = fill_middle.rearrange(df, **options)
    back = moved.withColumn("back", fill_middle.restored(moved, options.get("sentinels", Sentinels())))
    got = sorted((tuple(r) for r in back.collect()), key=repr)
    marks = options.pop("sentinels", Sentinels()).all
    want = sorted(((i, *by_hand(i, t, marks=marks, **options), t or "") for i, t, *_ in rows), key=repr)
    assert got == want
    return moved


def test_messy_rows_are_cut_as_by_hand(messy):
    moved = held(messy, ROWS)
    assert moved.columns == ["doc_id", *fill_middle.ADDED]


@pytest.mark.parametrize("suffix_first", [0, 100])
def test_each_form_is_rebuilt(spark, suffix_first):
    texts = [LONG, "  a b\n c  ", "\t", "one", "x <S y P> z <", "$1 \\ $ {2}", "a b\x85c 😀 d\ne", "<P> in text", "a<M>b", "\n\n a"]
    rows = [(10 * i + k, t, None, None) for i, t in enumerate(texts) for k in range(10)]
    moved = held(frame(spark, rows), rows, rate=100, suffix_first=suffix_first)
    forms = {r["form"] for r in moved.select("form").distinct().collect()}
    assert forms == {"plain", "spm" if suffix_first else "psm"}


def test_a_million_units_need_no_deep_stack(spark):
    rows = [(i, "ab  c\n" * 500_000, None, None) for i in range(3)]
    held(frame(spark, rows), rows, rate=100)


def test_marks_of_text_beside_marks_are_not_mistaken(spark):
    marks = Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(i, t, None, None) for i, t in enumerate(["a <|pre b", "|> < <| c", "<|suf| x >", "$0 <|mid|> y"] * 5)]
    held(frame(spark, rows), rows, rate=100, sentinels=marks)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "ba", "c")])
def test_marks_that_could_be_confused_are_refused(marks):
    with pytest.raises(ValueError):
        Sentinels(*marks)


def test_no_rows_and_a_map_only_plan(nothing, messy):
    assert fill_middle.rearrange(nothing).collect() == []
    plan = fill_middle.rearrange(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
