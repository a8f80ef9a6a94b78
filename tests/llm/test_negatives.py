import math
import random

import numpy as np
import pytest

from bindery.llm import four_russians as fr

SCHEMA = "vec_id long, embedding array<float>, label int, row string, planes string, anchor string, asked string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "x", "x", "x") for i, v, l in rows], SCHEMA).repartition(3)


def by_hand(rows):
    kept = []
    for i, v, l in rows:
        if i is None or v is None or l is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (l + 1) % 10 if i % 7 == 0 else l))
    out = []
    for a, (anchor, q, label) in enumerate(kept):
        if anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), i, n, l) for n, (i, p, l) in enumerate(kept) if n != a]
        scored.sort()
        for s, i, _, _ in [x for x in scored if x[3] == label][:5]:
            below = [x for x in scored if x[3] != label and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(anchor, i, r, x[1], -s, -x[0]) for r, x in enumerate(below, 1)]
    return sorted(out)


def vectors(seed, n, dims=64, labels=10):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, 0.15) for c in centres[l]], l) for i in range(n) for l in [rng.randrange(labels)]]


def check(spark, rows):
    got = sorted(map(tuple, fr.digest(table(spark, rows)).collect()))
    assert got == by_hand(rows)
    return got


def test_against_plain_scores(spark):
    assert len(check(spark, vectors(1, 400))) > 30


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(fr, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(fr, "CANDIDATE_BLOCK", 40)
    check(spark, vectors(2, 300))


def test_nulls_ties_repeats_and_other_lengths(spark):
    rows = vectors(3, 160, labels=3)
    v = rows[50][1]
    rows += [(None, v, 1), (500, None, 1), (501, v, None), (502, [None, *v[1:]], 1), (503, [float("nan"), *v[1:]], 1)]
    rows += [(504, [float("-inf"), *v[1:]], 1), (550, [], 2), (505, v[:13], 0), (506, v + [0.5] * 9, 1)]
    rows += [rows[50]] * 2 + [(600 + i, v, i % 3) for i in range(9)] + [(-50, v, 2), (-7, v, 2), (50, rows[1][1], 1)]
    assert check(spark, rows)


def test_hot_label_and_few_rows(spark):
    rows = [(i, v, 1 if i % 3 else l) for i, v, l in vectors(4, 200)]
    check(spark, rows)
    check(spark, rows[:3])
    assert fr.digest(table(spark, []).limit(0)).collect() == []
    assert fr.digest(table(spark, [(50, None, 1)])).collect() == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="must stay below"):
        fr.digest(table(spark, [(50, [1e9], 1)])).collect()


@pytest.mark.parametrize("high", [1, 2, 255, 256, 70_000, 2**23])
def test_scores_are_exact(high):
    rng = np.random.default_rng(high)
    anchors, candidates = rng.integers(-high, high, (9, 24)), rng.integers(-high, high, (700, 24))
    packed = fr.planes_of(candidates)
    assert (fr.integers_of(packed) == candidates).all()
    assert (fr.SubsetSums(anchors).scores(packed) == candidates @ anchors.T).all()
    widened = fr.unpacked([p.tobytes() for p in packed[:5]] + [fr.planes_of(np.full((1, 24), -(2**23)))[0].tobytes()], 3)
    assert (fr.integers_of(widened[:5]) == candidates[:5]).all() and (fr.integers_of(widened[5:]) == -(2**23)).all()
