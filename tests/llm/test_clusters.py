import hashlib
import random

import numpy as np
import pytest

from bindery.llm import equal_average as ea

SCHEMA = "vec_id long, embedding array<float>, cluster string, label string, distance string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def by_hand(rows, k=8, rounds=10, dims=64):
    kept = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(named)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centroids[n] = [sum(column) // len(vs) for column in zip(*vs)]
    placed = [(i, *reversed(nearest(v))) for i, v in kept]
    per = {}
    for _, n, d in placed:
        per[n] = per.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, per[n], sum(per.values()), sha[n]) for i, n, d in placed), key=repr)


def vectors(seed, n, spread=0.1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def check(spark, rows):
    got = sorted((tuple(r) for r in ea.digest(table(spark, rows)).collect()), key=repr)
    assert got == by_hand(rows)


def test_against_plain_rounds(spark):
    check(spark, vectors(1, 150))


def test_nulls_ties_repeats_and_other_lengths(spark):
    rows = vectors(2, 60)
    rows += [(100, None), (None, rows[3][1]), (None, None), (101, []), (102, rows[0][1][:63]), (103, [None] + rows[0][1][1:])]
    rows += [(104, [float("nan")] + rows[0][1][1:]), (105, [float("inf")] + rows[0][1][1:])]
    rows += [rows[5]] * 3 + [(106 + i, rows[7][1]) for i in range(9)] + [(7, rows[9][1]), (200, [0.0] * 64), (201, [-0.0] * 64)]
    check(spark, rows)


def test_fewer_than_k_and_empty(spark):
    check(spark, vectors(3, 5))
    assert ea.digest(table(spark, [(1, None), (None, [0.5] * 64)])).collect() == []
    assert ea.digest(table(spark, []).limit(0)).collect() == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="must stay below"):
        ea.digest(table(spark, [(1, [1e9] * 64)])).collect()


@pytest.mark.parametrize("k", [1, 2, 7, 60])
def test_search_is_exact(k):
    rng = np.random.default_rng(k)
    for low, high in ((-3, 4), (-800, 800), (-(2**23), 2**23)):
        centroids, x = rng.integers(low, high, (k, 64)), rng.integers(low, high, (400, 64))
        centroids[k // 2] = centroids[0]  # a tie for every vector
        label, best = ea.NearestCentroid(centroids).find(x)
        distances = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (best == distances.min(1)).all() and (label == distances.argmin(1)).all()
