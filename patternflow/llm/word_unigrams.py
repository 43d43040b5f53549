"""Unigram word counts of a training set, and what they say of every text.

Exact counts at any size: words are counted inside tasks and summed by Spark. The words most frequent
over all texts, at most ``COMMON``, are broadcast; a text's other words are joined by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref, staged

#: Broadcast words, and their longest length in bytes.
COMMON = 1 << 17
LONGEST_COMMON = 48
#: Distinct words that a task holds before it passes its counts on.
HELD = 1 << 19

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lowered_words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased: ``bytes.split`` parts at the same six characters."""
    return (text or b"").translate(_LOWER).split()


@dataclass(frozen=True)
class WordCounts:
    """``table`` (word, total, trained): occurrences in all texts and in training texts.

    ``tokens`` and ``distinct`` are of the training texts, each with its end as one more token.
    """

    table: DataFrame
    common: dict[bytes, int]
    ends: int
    tokens: int
    distinct: int

    @property
    def log_total(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))

    def byte_weights(self) -> np.ndarray:
        """How often each byte, and the end, stands in training texts; white space by the number of words."""
        weights = np.zeros(257)
        for word, n in self.common.items():
            np.add.at(weights, np.frombuffer(word, np.uint8), n)
        weights[32] += self.tokens - self.ends
        weights[10] += (self.tokens - self.ends) / 20
        weights[256] += self.ends
        return weights


def count_words(docs: DataFrame, text_col: str, trained_col: str) -> WordCounts:
    """The counts of ``docs``, whose ``trained_col`` says which texts train."""
    ensure_on_executors(docs.sparkSession)
    rows = docs.select(ref(text_col).cast("string").alias("text"), ref(trained_col).cast("boolean").alias("trained"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, trained in zip(batch.column("text").cast(pa.binary()), batch.column("trained").to_pylist(), strict=True):
                held[bool(trained)].update(lowered_words(text.as_py()))
                if len(held[True]) + len(held[False]) > HELD:
                    yield from _passed_on(held)
        yield from _passed_on(held)

    parts = rows.mapInArrow(count, "word binary, total long, trained long")
    table = staged(parts.groupBy("word").agg(F.sum("total").alias("total"), F.sum("trained").alias("trained")), "words", compression="zstd")
    ends = rows.filter("trained").count()
    words = table.agg(F.sum("trained"), F.count(F.when(F.col("trained") > 0, 1))).first()
    # At most COMMON rows of bounded length; the rest never leaves the executors.
    top = (
        table.filter(F.octet_length("word") <= LONGEST_COMMON)
        .orderBy(F.col("total").desc(), "word")
        .limit(COMMON)
        .select("word", "trained")
        .toArrow()
    )
    common = dict(zip(top["word"].to_pylist(), top["trained"].to_pylist(), strict=True))
    return WordCounts(table, common, ends, (words[0] or 0) + ends, words[1] + (ends > 0))


def _passed_on(held: dict[bool, Counter]) -> Iterator[pa.RecordBatch]:
    for trained, counter in held.items():
        if counter:
            # Words alike at their start lie side by side, so that their shuffle is compressed better.
            words = sorted(counter)
            n = pa.array([counter[w] for w in words], pa.int64())
            zero = pa.array(np.zeros(len(words), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), n, n if trained else zero], ["word", "total", "trained"])
            counter.clear()


def score_texts(texts: DataFrame, counts: WordCounts) -> DataFrame:
    """One row per row of ``texts`` (row, id, text), whose numbers are distinct: row, id, n_tokens, n_known, base_score.

    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the text's words and its end.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts.common)
    rows = texts.select("row", "id", "text")
    end_log, ends = math.log10(counts.ends + 0.5), counts.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words that never train have no logarithm here; they are few, and looked at last.
        logs = {w: math.log10(c + 0.5) for w, c in shared.value.items() if c}
        untrained = {w for w, c in shared.value.items() if not c}
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                out = {k: [] for k in ("n_tokens", "n_known", "base", "rare", "rare_n")}
                for text in part.column("text").cast(pa.binary()):
                    words = lowered_words(text.as_py())
                    met = list(map(logs.get, words))
                    missed = Counter(w for w, log in zip(words, met, strict=True) if log is None)
                    known = len(words) - missed.total() + (ends > 0)
                    base = end_log + sum(filter(None, met))
                    rare = [w for w in missed if w not in untrained]
                    rare_n = [missed[w] for w in rare]
                    base += math.log10(0.5) * (missed.total() - sum(rare_n))
                    out["n_tokens"].append(len(words) + 1)
                    out["n_known"].append(known)
                    out["base"].append(base)
                    out["rare"].append(rare)
                    out["rare_n"].append(rare_n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("id"),
                        pa.array(out["n_tokens"], pa.int64()),
                        pa.array(out["n_known"], pa.int64()),
                        pa.array(out["base"], pa.float64()),
                        pa.array(out["rare"], pa.list_(pa.binary())),
                        pa.array(out["rare_n"], pa.list_(pa.int64())),
                    ],
                    ["row", "id", "n_tokens", "n_known", "base", "rare", "rare_n"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_tokens long, n_known long, base double, rare array<binary>, rare_n array<long>"
    # Written once, as it is used twice below.
    scored = staged(rows.mapInArrow(run, schema), "scored-texts", compression="zstd")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w"))
    c = F.coalesce("trained", F.lit(0))
    looked_up = (
        rare.select("row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("n"))
        .join(counts.table.filter("trained > 0").select("word", "trained"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    )
    return scored.drop("rare", "rare_n").join(looked_up, "row", "left").select(
        "row",
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(counts.log_total)).alias("base_score"),
    )
