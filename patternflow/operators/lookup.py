"""A left join against a keyed table that no hot key can slow down."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from patternflow.functions.columns import ref

# A key is hot when it holds a thousandth of all rows, so at most 1000 keys are.
HOT_SHARE = 0.001
HOT_MIN_ROWS = 10_000


def attach(
    left: DataFrame, right: DataFrame, key: str, *, hot_min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """``left`` with the columns of the one row of ``right`` sharing its ``key``, if any.

    Rows with hot keys meet a broadcast of just those keys (at most 1000 rows of
    ``right``); all others join by shuffle, where every key is now small. One aggregate tells the rows of the
    most frequent keys and, observed on its way in, of all of them.
    """
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    counts = left.observe(seen, F.count(F.lit(1)).alias("total")).groupBy(ref(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter("key IS NOT NULL").orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).collect()
    bar = max(hot_min_rows, int((seen.get.get("total") or 0) * HOT_SHARE))
    hot = [r["key"] for r in top if r["n"] >= bar]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(ref(key).isin(hot), F.lit(False))
    fast = left.filter(is_hot).join(F.broadcast(right.filter(ref(key).isin(hot))), key, "left")
    return fast.unionByName(left.filter(~is_hot).join(right, key, "left"))
