import numpy as np
from pyspark.sql import functions as F

from bindery.llm import stable_projections as sp

SCHEMA = "vec_id long, embedding array<float>, label int, block_id string, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, k):
    """All pairs; rows are (id, vector) with distinct ids."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_and_scores(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 200), ("BLOCK_ROWS", 150), ("QUERIES", 10)):
        monkeypatch.setattr(sp, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + 0.5 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    got, want = found(sp.digest(table(spark, rows))), exact(rows, 20)
    assert recall(got, want) >= 0.9
    x = dict(rows)
    for q, hits in got.items():
        scores = [s for _, s in hits]
        assert scores == sorted(scores, reverse=True) and len(hits) == 20 and q not in {i for i, _ in hits}
        for i, s in hits:
            assert np.isclose(s, np.float32(x[i]).astype(float) @ np.float32(x[q]).astype(float), rtol=0, atol=1e-12)


def test_ties_and_hot_vector(spark):
    hot, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, hot) for i in range(0, 400)] + [(1000 + i, other) for i in range(5)]
    got = found(sp.digest(table(spark, rows)))
    assert [i for i, _ in got[0]] == list(range(1, 21))
    assert [i for i, _ in got[20]] == list(range(20))
    assert [i for i, _ in got[1000]][:4] == [1001, 1002, 1003, 1004]
    assert [i for i, _ in got[1000]][4:] == list(range(16))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.5]), (None, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (20, [0.0, 0.0]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (9, []),
    ]
    got = found(sp.digest(table(spark, rows)))
    assert got == {0: [(40, 5.0), (1, 4.0), (2, 0.0)], 40: [(0, 5.0), (1, 4.0), (2, 0.0)]}
    assert sp.digest(table(spark, rows).limit(0)).collect() == []
    assert found(sp.nearest(table(spark, rows), F.col("vec_id") == 1, k=1)) == {1: [(0, 4.0)]}
    assert sp.digest(table(spark, [(0, [1.0, 1.0])])).collect() == []


def test_quantile():
    assert np.isclose(sp.chi_square_quantile(0.95, 8), 15.507313, atol=1e-5)
