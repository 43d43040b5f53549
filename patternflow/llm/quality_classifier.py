"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Training takes a bounded sample of labelled rows, dealt to a few shards; each shard's
task runs FTRL-proximal over its rows, and the weight vectors are averaged. A text's
score is the sparse dot product of its n-gram frequencies with the weights.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, narrowed, ref

BUCKET_BITS = 18
#: Labelled rows that training takes at most, those of the lowest hash of the identifier.
MOST_TRAINING_ROWS = 20_000
#: Tasks that train at the same time, each on its share.
SHARDS = 8
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Frequencies sum to this, once per order of n-grams.
SCALE = 20.0
CHUNK = 1 << 19

_CLASSES: np.ndarray | None = None
_GAP = re.compile(r"\s")
_CAPITALS = np.uint64(11)
_AGAIN = np.uint64(13)


def _classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter or digit, 2 capital letter, 3 anything else."""
    global _CLASSES
    if _CLASSES is None:
        kinds = (
            0 if ch.isspace() else (2 if ch.isupper() else 1) if ch.isalnum() else 3
            for ch in map(chr, range(sys.maxunicode + 1))
        )
        _CLASSES = np.fromiter(kinds, np.uint8, sys.maxunicode + 1)
    return _CLASSES


def _pieces(text: str, limit: int) -> Iterator[tuple[str, str]]:
    """``text`` cut at white space into pieces of about ``limit`` characters, each behind the token that comes before it."""
    at, last = 0, ""
    while len(text) - at > limit:
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        yield last, text[at:end]
        last = _last_token(text, at, end) or last
        at = end
    yield last, text[at:]


def _last_token(text: str, at: int, end: int) -> str:
    """The last token of ``text[at:end]``, empty where there is none."""
    while end > at and text[end - 1].isspace():
        end -= 1
    start = end
    while start > at and not text[start - 1].isspace() and text[start - 1].isalnum() == text[end - 1].isalnum():
        start -= 1
    return text[start:end]


def _features(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every unigram and bigram, in chunks that never share a piece; ``limit`` changes nothing.

    Tokens are runs of letters and digits or runs of other visible characters. A word all
    in capitals is one token whatever it says, and so is a bigram that repeats its
    token: both are habits of a text, not words of it.
    """
    parts: list[str] = []
    numbers: list[int] = []
    leads: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        for lead, piece in _pieces(text or "", limit):
            parts.append(lead + piece)
            numbers.append(number)
            leads.append(len(lead))
            held += len(lead) + len(piece) + 1
            if held >= limit:
                yield _hashed(parts, numbers, leads)
                parts, numbers, leads, held = [], [], [], 0
    if parts:
        yield _hashed(parts, numbers, leads)


def _hashed(parts: list[str], numbers: list[int], leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of ``parts``, whose first ``leads`` characters were counted before and only pair with what follows."""
    codes = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    run = np.where(kind == 2, 1, kind)
    edge = np.flatnonzero(np.diff(run, prepend=0, append=0))
    start, end = edge[:-1], edge[1:]
    seen = run[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[seen], end[seen]
    # A token's hash: the difference of running sums of code * base^place, shifted back to place 0.
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    n = len(codes)
    power = np.cumprod(np.full(n, base, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.cumprod(np.full(n, inverse, np.uint64))
    token = (sums[end] - sums[start]) * back[start]
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    shouted = (end - start >= 2) & (capitals[end] - capitals[start] == end - start)
    token = np.where(shouted, _CAPITALS, token)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    piece = np.repeat(np.arange(len(parts)), lengths)[start]
    owner = np.array(numbers, np.int64)[piece] if len(parts) else np.zeros(0, np.int64)
    follows = piece[1:] == piece[:-1]
    pair = np.where(token[1:] == token[:-1], _AGAIN, token[:-1] * np.uint64(0xD6E8FEB86659FD93) + token[1:])[follows]
    own = start - (np.cumsum(lengths) - lengths)[piece] >= np.array(leads, np.int64)[piece]
    hashes = np.concatenate([token[own], pair])
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([owner[own], owner[1:][follows]])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


class _Ftrl:
    """FTRL-proximal for one logistic regression; the last coordinate is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BUCKET_BITS) + 1)
        self.n = np.zeros((1 << BUCKET_BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.sign(z) * L1 - z
        return np.where(np.abs(z) > L1, pull / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        square = gradient * gradient
        self.z[at] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + square


def _rows(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, coordinates, values) of each text, the bias included."""
    held: dict[int, list[np.ndarray]] = {i: [] for i in range(len(texts))}
    for bucket, owner in _features(texts):
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part, who in zip(np.split(bucket, cuts), owner[np.r_[0, cuts]] if len(owner) else [], strict=False):
            held[int(who)].append(part)
    for i, parts in held.items():
        every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        at, n = np.unique(every, return_counts=True)
        yield i, np.append(at, 1 << BUCKET_BITS), np.append(n * (SCALE / max(1, len(every))), 1.0)


def train(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    most_rows: int = MOST_TRAINING_ROWS,
) -> QualityModel:
    """A model of at most ``most_rows`` labelled documents, one row for each identifier.

    Of an identifier that several rows share the smallest text trains.
    Of an identifier labelled more than once the lowest label holds; null labels are left
    out. Without any row all weights are zero, and every text scores one half.
    """
    spark = docs.sparkSession
    ensure_on_executors(spark)
    label = narrowed(labelled, id_col, label_col).select(ref(id_col).alias("id"), ref(label_col).cast("int").alias("label"))
    sample = (
        label.dropna().groupBy("id").agg(F.min("label").alias("label"))
        .withColumn("turn", F.xxhash64("id"))
        .orderBy("turn", "id")
        .limit(most_rows)
    )
    # The sample's size is bounded by the parameter, so it is broadcast and the texts stay in place.
    rows = (
        docs.select(ref(id_col).alias("id"), ref(text_col).cast("string").alias("text"))
        .join(F.broadcast(sample), "id")
        .groupBy("id", "turn", "label")
        .agg(F.min("text").alias("text"))
        .withColumn("shard", F.pmod("turn", F.lit(SHARDS)))
        .repartition(SHARDS, "shard")
        .sortWithinPartitions("turn", "id", "text")
        .select("text", "label")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = _Ftrl(), []
        for batch in batches:
            labels = batch.column("label").to_pylist()
            kept += [(at, x, labels[i]) for i, at, x in _rows(batch.column("text").to_pylist())]
        for _ in range(EPOCHS):
            for at, x, y in kept:
                model.learn(at, x, y)
        if kept:
            packed = model.weights().astype(np.float32).tobytes()
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(kept)], pa.int64()), "weights": pa.array([packed], pa.binary())})

    total, seen = np.zeros((1 << BUCKET_BITS) + 1), 0
    for r in rows.mapInArrow(learn, "rows long, weights binary").toLocalIterator():  # one vector per shard
        total += r["rows"] * np.frombuffer(r["weights"], np.float32)
        seen += r["rows"]
    mean = total / max(1, seen)
    return QualityModel(mean[:-1].astype(np.float32), float(mean[-1]))


def score_of(df: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """The probability of label 1 for ``df``'s text column; null and empty texts get the bias alone."""
    ensure_on_executors(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            total, n = np.zeros(len(texts)), np.zeros(len(texts))
            for bucket, owner in _features(texts.to_pylist()):
                total += np.bincount(owner, weights=model.weights[bucket], minlength=len(texts))
                n += np.bincount(owner, minlength=len(texts))
            margin = model.bias + SCALE * total / np.maximum(n, 1)
            yield pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(ref(text_col).cast("string"))


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier, score, predicted (1 from one half up).

    Very long texts are read whole, in pieces; where they are cut changes no score.
    """
    scored = df.select(ref(id_col).alias(id_col), score_of(df, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


__all__ = ["QualityModel", "score", "score_of", "train"]
