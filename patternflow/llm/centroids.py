"""Centroid clustering: Lloyd's rounds in whole numbers, nearest centroids by Walsh-Hadamard progressive search.

A vector becomes 64 whole numbers, and so do its Walsh-Hadamard coefficients: squared coefficient
differences add up to exactly 64 times the squared distance. They are added up coarse to fine, coefficients of
few sign changes first, for all centroids at once. The centroid that is ahead after the coarsest level is finished at
once and bounds the others: one whose sum so far is strictly above the bound can't win and is left out. Those
that remain are finished over all 64, so the distance is exact and ties go to the smallest number.

Spark partitions the vectors. A task returns one row of sums per centroid and round; the driver sees the added-up
components of the centroids, never a vector beyond those it starts from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import ensure_on_executors, ref, staged

DIMENSIONS = 64
SCALE = 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
#: Coefficients after which centroids are compared with the bound.
LEVELS = (1, 2, 4, 8, 16, 32, 64)
#: Components below this are summed in 64-bit numbers without overflow; larger ones as Python's.
NARROW = 1 << 23
#: Components from here on count as not finite: their squares would leave even 38 digits.
WIDEST = 1 << 40
#: Vectors compared at a time.
BLOCK = 4096
#: Sums of components leave a task in two parts, of which this is the lower one's range.
_LIMB = 1 << 32
_LONGEST = (1 << 63) - 1


def _sequency(size: int) -> np.ndarray:
    """The order of a natural Hadamard transform's coefficients by sign changes."""
    rows = walsh_hadamard(np.eye(size, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def walsh_hadamard(vectors: np.ndarray) -> np.ndarray:
    """The transform of each row, in the natural order, by sums and differences only."""
    out, half = vectors.copy(), 1
    while half < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(out.shape)
        half *= 2
    return out


_COARSE_TO_FINE = _sequency(DIMENSIONS)


def coefficients(vectors: np.ndarray) -> np.ndarray:
    return walsh_hadamard(vectors)[:, _COARSE_TO_FINE]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, and how many coefficient differences it took.

    Exact: wide components are worked on as Python numbers, of any size.
    """
    widest = max(_widest(vectors), _widest(centroids))
    kind = np.int64 if widest < NARROW else object
    here, there = coefficients(vectors.astype(kind)), coefficients(centroids.astype(kind))
    n, k = len(here), len(there)
    sums = np.zeros((n, k), kind)
    row, number = (x.ravel() for x in np.indices((n, k)))
    low, bound, work = 0, None, 0
    for high in LEVELS:
        sums[row, number] += ((here[row, low:high] - there[number, low:high]) ** 2).sum(axis=1)
        work += len(row) * (high - low)
        if bound is None:
            lead = np.argmin(sums, axis=1)
            bound = sums[np.arange(n), lead] + ((here[:, high:] - there[lead, high:]) ** 2).sum(axis=1)
            work += n * (DIMENSIONS - high)
        left = (sums[row, number] <= bound[row]).astype(bool)
        row, number, low = row[left], number[left], high
    alive = np.zeros((n, k), bool)
    alive[row, number] = True
    # Sums of those left out are not complete, but above the bound and so above the best.
    best = np.argmin(np.where(alive, sums, sums.max() + 1), axis=1) if n else np.zeros(0, np.int64)
    return best, sums[np.arange(n), best] // DIMENSIONS, work


def _widest(numbers: np.ndarray) -> int:
    return int(np.abs(numbers).max()) if numbers.size else 0


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the usable vectors, each component as the floor of ``SCALE`` times it.

    Usable are those of exactly 64 components, none null, NaN, infinite or beyond 2^40 after scaling.
    """
    wide = ref(vector_col).cast("array<double>")
    scaled = F.transform(wide, lambda x: x * SCALE)
    # A comparison with NaN holds on its upper side only: NaN counts as above every number.
    fits = F.forall(scaled, lambda x: F.coalesce((x < WIDEST) & (x > -WIDEST), F.lit(False)))
    kept = df.select(ref(id_col).alias("id"), wide.alias("wide"), fits.alias("fits")).filter(
        (F.size("wide") == DIMENSIONS) & F.col("fits")
    )
    return kept.select("id", F.transform("wide", lambda x: F.floor(x * SCALE)).alias("v"))


def starting_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose identifiers hash lowest, in that order; of equal hashes the smaller components come first."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(key.cast("binary"), 256).alias("hash"), "v").orderBy("hash", "v").limit(clusters)
    return np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, DIMENSIONS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            yield piece, piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of their vectors' mean, or as they were if they have none."""
    k = len(centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, DIMENSIONS), object), np.zeros(k, np.int64)
        for _, block in _blocks(batches):
            number, _, _ = nearest(block, centroids)
            count += np.bincount(number, minlength=k)
            for i in np.unique(number):
                sums[i] += block[number == i].sum(axis=0).astype(object)
        met = np.flatnonzero(count)
        upper, lower = sums[met] // _LIMB, sums[met] % _LIMB
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met]), *(pa.array(x.tolist(), pa.list_(pa.int64())) for x in (upper, lower))],
            ["cluster", "count", "upper", "lower"],
        )

    parts = vectors.select("v").mapInArrow(add_up, "cluster int, count long, upper array<long>, lower array<long>")
    by_component = parts.select("cluster", "count", F.posexplode(F.arrays_zip("upper", "lower")).alias("place", "part"))
    totals = by_component.groupBy("cluster", "place").agg(
        F.sum("count").alias("count"), F.sum("part.upper").alias("upper"), F.sum("part.lower").alias("lower")
    )
    moved = centroids.copy()
    for r in totals.collect():  # a row per component of a centroid
        moved[r["cluster"], r["place"]] = (r["upper"] * _LIMB + r["lower"]) // r["count"]
    return moved


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per usable vector: identifier, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256.

    ``distance`` is squared and exact; the inertias add it up over the vector's cluster and over all vectors. One
    that no long holds is null. ``centroid`` holds the final components. Vectors that are null, of another length
    or with a component that is null, not finite or 2^30 and more are left out. With fewer vectors than clusters each starts a cluster; of
    centroids that are equal the one with the smallest number gets the vectors, and the others stay as they are.
    Rows that repeat count as often as they occur, also among those the clusters start from; a null
    identifier reads as empty text there. An empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    ensure_on_executors(spark)
    vectors = staged(whole_vectors(df, id_col, vector_col), "whole-vectors")
    centroids = starting_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, block in _blocks(batches):
            number, distance, _ = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.decimal128(38, 0))],
                ["id", "cluster", "distance"],
            )

    kind = vectors.schema["id"].dataType.simpleString()
    assigned = staged(vectors.mapInArrow(assign, f"id {kind}, cluster int, distance decimal(38,0)"), "assigned")
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(inertia.values())
    rows = [
        (i, _as_long(inertia[i]), _as_long(total), [int(x) for x in c], hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
        if i in inertia
    ]
    shown = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    exact = F.col("distance")
    return assigned.join(F.broadcast(shown), F.col("cluster") == F.col("number")).select(
        F.col("id").alias(id_col),
        "cluster",
        F.when(exact <= _LONGEST, exact).cast("long").alias("distance"),
        "cluster_inertia",
        "inertia",
        "centroid",
        "centroid_sha256",
    )


def _as_long(number: int) -> int | None:
    return number if number <= _LONGEST else None
