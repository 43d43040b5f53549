"""Centroid clustering against plain Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from patternflow.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, id int, v string, cluster int, number int"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], schema)


def whole(v):
    if v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in v]
    return out if all(abs(x) < 2**40 for x in out) else None


def by_hand(rows, k=8, rounds=10, seed=3):
    kept = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    start = [w for _, w in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c)), j) for j, c in enumerate(start))

    for _ in range(rounds):
        own = [[] for _ in start]
        for _, w in kept:
            own[nearest(w)[1]].append(w)
        start = [[sum(x) // len(ws) for x in zip(*ws)] if ws else c for c, ws in zip(start, own)]
    found = [(i, *nearest(w)) for i, w in kept]
    total = sum(d for _, d, _ in found)
    per = {j: sum(d for _, d, c in found if c == j) for j in range(len(start))}
    fits = lambda x: x if x < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in start]
    return sorted(((i, j, fits(d), fits(per[j]), fits(total), sha[j]) for i, d, j in found), key=repr)


def held(spark, rows, **options):
    got = centroids.cluster(table(spark, rows), **options)
    shown = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted((tuple(r) for r in shown), key=repr) == by_hand(rows, options.get("clusters", 8))


def some_vectors(n, seed=1, scale=0.2):
    rnd = random.Random(seed)
    hearts = [[rnd.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    return [[x + rnd.gauss(0, scale / 3) for x in hearts[i % 5]] for i in range(n)]


def test_clusters_match_plain_numbers(spark):
    held(spark, list(enumerate(some_vectors(300))))


def test_odd_rows_have_defined_results(spark):
    good = some_vectors(12)
    odd = [None, [], good[0][:63], [*good[0], 0.1], [None, *good[0][1:]], [math.nan, *good[0][1:]], [-math.inf, *good[0][1:]], [1e300, *good[0][1:]]]
    rows = [*enumerate(good), (None, good[3]), (None, good[4]), (2, good[2]), (2, good[2]), *((100 + i, v) for i, v in enumerate(odd))]
    held(spark, rows)


def test_ties_go_to_the_smallest_number(spark):
    zero, one = [0.0] * 64, [1.0] * 64
    half = [1.0, 0.0] * 32
    held(spark, [(i, v) for i, v in enumerate([zero, one, half] * 4 + [zero] * 5)])


def test_wide_components_stay_exact(spark):
    good = some_vectors(20)
    held(spark, [*enumerate(good), (50, [1e6, *good[1][1:]]), (51, [1e6 + 0.25, *good[1][1:]]), (52, [-9e8] * 64), (53, [1e8] * 64)])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    held(spark, list(enumerate(some_vectors(n))))


def test_integer_and_float_columns(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(some_vectors(40))]
    floats = table(spark, rows, SCHEMA.replace("array<double>", "array<float>"))
    got = centroids.cluster(floats).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_transform_is_exact_and_coarse_to_fine():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(2**20), 2**20, (2, 50, 64))
    difference = centroids.coefficients(a) - centroids.coefficients(b)
    assert ((difference**2).sum(axis=1) == 64 * ((a - b) ** 2).sum(axis=1)).all()
    signs = centroids.coefficients(np.eye(64, dtype=np.int64)).T
    assert [int((r[1:] != r[:-1]).sum()) for r in signs] == list(range(64))


def test_search_leaves_out_most_of_the_work_and_nothing_else():
    rng = np.random.default_rng(9)
    hearts = np.repeat(rng.integers(-400, 400, (16, 8)), 8, axis=1)
    points = hearts[rng.integers(0, 16, 5000)] + rng.integers(-20, 20, (5000, 64))
    number, distance, work = centroids.nearest(points, hearts)
    every = ((points[:, None, :] - hearts[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert work < 0.5 * every.size * 64
