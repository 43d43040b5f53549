"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language inside the tasks that read the texts;
only non-zero counts leave them, summed again by Spark. The log-probability matrix is
broadcast in blocks of at most ``BLOCK`` languages, which bounds each broadcast. Scoring gathers the matrix rows
of each text's n-grams and sums them per text in numpy, block by block, keeping the best language and the sum so far.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Languages in a block of the matrix, which has a row for each bucket and a column for each language: 64 MB at most.
BLOCK = 256
#: Languages whose counts a task holds before it passes them on.
HELD = 64
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Characters handled at once; longer texts go through in overlapping pieces.
CHUNK = 1 << 19

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once in each Python worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTERS


@dataclass(frozen=True)
class Chunk:
    """Pieces of texts behind one another. A piece reads up to max(ORDERS) - 1 characters more than it owns."""

    codes: np.ndarray
    starts: np.ndarray
    owned: np.ndarray
    texts: np.ndarray


def _chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[Chunk]:
    """All texts, lower-cased, in chunks of about ``limit`` characters."""
    ahead = max(ORDERS) - 1
    parts: list[str] = []
    owned: list[int] = []
    numbers: list[int] = []
    held = 0

    def packed() -> Chunk:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths) - lengths
        return Chunk(codes, starts, np.array(owned, np.int64), np.array(numbers, np.int64))

    for number, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, len(low), limit):
            own = min(limit, len(low) - at)
            parts.append(low[at : at + own + ahead])
            owned.append(own)
            numbers.append(number)
            held += own
            if held >= limit:
                yield packed()
                parts, owned, numbers, held = [], [], [], 0
    if parts:
        yield packed()


def _hashed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram that has a letter, and which texts have one.

    Characters other than letters count as one kind of gap.
    """
    letter = _letters()[chunk.codes]
    codes = np.where(letter, chunk.codes, np.uint32(32)).astype(np.uint64)
    n = len(codes)
    ends = np.append(chunk.starts[1:], n)
    piece = np.repeat(np.arange(len(chunk.starts)), ends - chunk.starts)
    inside = np.arange(n) - chunk.starts[piece]
    mine = inside < chunk.owned[piece]
    room = ends[piece] - np.arange(n)
    buckets, owners = [], []
    rolled = np.zeros(n, np.uint64)
    lettered = np.zeros(n, bool)
    for k in range(1, max(ORDERS) + 1):
        rolled[: n - k + 1] = rolled[: n - k + 1] * np.uint64(1_000_003) + codes[k - 1 :]
        lettered[: n - k + 1] |= letter[k - 1 :]
        if k in ORDERS:
            use = np.flatnonzero(mine & (room >= k) & lettered)
            mixed = (rolled[use] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - 16)).astype(np.int32))
            owners.append(chunk.texts[piece[use]])
    return np.concatenate(buckets), np.concatenate(owners), np.unique(chunk.texts[piece[letter & mine]])


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` in code point order, ``blocks`` of weights (BUCKETS x at most BLOCK languages) and ``priors`` as logarithms."""

    languages: tuple[str, ...]
    blocks: tuple[np.ndarray, ...]
    priors: np.ndarray


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of all rows that have a text and a language, of which there may be any number.

    A language takes 256 kB of the model. Without a row the model is empty.
    """
    ensure_on_executors(df.sparkSession)
    rows = df.select(ref(text_col).cast("string").alias("text"), ref(lang_col).cast("string").alias("lang")).dropna()
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), (), np.zeros(0))
    place = {name: i for i, name in enumerate(languages)}

    def passed_on(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, table in held.items():
            bucket = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bucket), lang, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[bucket])],
                ["lang", "bucket", "n"],
            )
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for chunk in _chunks(batch.column("text").to_pylist()):
                bucket, owner, _ = _hashed(chunk)
                met, index = np.unique(langs[owner], return_inverse=True)
                # Rows of one language at a time; a chunk has a few languages or few n-grams of each.
                order = np.argsort(index, kind="stable")
                for lang, part in zip(met.tolist(), np.split(bucket[order], np.flatnonzero(np.diff(index[order])) + 1), strict=False):
                    if lang not in held:
                        if len(held) == HELD:
                            yield from passed_on(held)
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang] += np.bincount(part, minlength=BUCKETS)
        yield from passed_on(held)

    summed = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    blocks = [np.zeros((BUCKETS, min(BLOCK, len(languages) - a)), np.float32) for a in range(0, len(languages), BLOCK)]
    for block in blocks:
        block -= np.float32(np.log(BUCKETS))  # a language without any n-gram
    for row in packed.toLocalIterator():  # a row for each language, of BUCKETS counts at most
        bucket, n = np.array(row["counts"], np.int64).T
        column = np.full(BUCKETS, SMOOTHING)
        column[bucket] += n
        blocks[row["lang"] // BLOCK][:, row["lang"] % BLOCK] = np.log(column) - np.log(column.sum())
    seen = np.array([counts[x] for x in languages], float)
    return LanguageModel(languages, tuple(blocks), np.log(seen / seen.sum()))


def has_letter(text: Column) -> Column:
    """Whether the text has a letter, as ``language_of`` tells it."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([any(map(str.isalpha, (x or "").lower())) for x in texts.to_pylist()], pa.bool_())

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(found, "boolean")(text.cast("string"))


def language_of(df: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A struct of lang and score, with the logarithms best and total behind it, for ``df``'s text column.

    ``score`` is the posterior probability of the language; of equally likely ones the first in
    code point order is taken. A text that is null or has no letter, or any text under an
    empty model, is ``und`` with score 0.
    """
    ensure_on_executors(df.sparkSession)
    text = ref(text_col).cast("string")
    found = F.struct(
        F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(float("-inf")).alias("best"), F.lit(float("-inf")).alias("total")
    )
    for number, weights in enumerate(model.blocks):
        part = slice(number * BLOCK, number * BLOCK + weights.shape[1])
        found = _better(df, (model.languages[part], weights, model.priors[part]))(text, found)
    return found


def _better(df: DataFrame, block: tuple[tuple[str, ...], np.ndarray, np.ndarray]) -> Callable[[Column, Column], Column]:
    """A function of a text and the best language so far, which takes in the languages of ``block``."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    def predict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        languages, weights, priors = shared.value
        for texts, so_far in batches:
            sums = np.tile(priors, (len(texts), 1))
            known = np.zeros(len(texts), bool)
            for chunk in _chunks(texts.to_pylist()):
                bucket, owner, lettered = _hashed(chunk)
                known[lettered] = True
                for k, column in enumerate(weights.T):
                    sums[:, k] += np.bincount(owner, weights=column[bucket], minlength=len(texts))
            lang, _, best, total = (so_far.field(i) for i in range(4))
            best = best.to_numpy(zero_copy_only=False)
            top = sums.max(axis=1)
            ahead = known & (top > best)
            total = np.logaddexp(total.to_numpy(zero_copy_only=False), top + np.log(np.exp(sums - top[:, None]).sum(axis=1)))
            best = np.where(ahead, top, best)
            lang = pc.if_else(pa.array(ahead), pa.array(languages).take(pa.array(sums.argmax(axis=1))), lang)
            score = np.where(known, np.minimum(1.0, np.exp(best - total)), 0.0)
            yield pa.StructArray.from_arrays([lang, pa.array(score), pa.array(best), pa.array(total)], ["lang", "score", "best", "total"])

    predict.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(predict, "lang string, score double, best double, total double")


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier, lang_pred, score; other columns are ignored."""
    named = df.select(ref(id_col).alias(id_col), language_of(df, model, text_col).alias("_found"))
    return named.select(ref(id_col), F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))
