import random

import pytest
from pyspark.sql import functions as F

from bindery.llm.linkage import components, linked


def by_hand(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def cases():
    rng = random.Random(6)
    yield "chain", [(i, i + 1) for i in range(60)]
    yield "hub", [(1000, i) for i in range(300)] + [(7, 2000)]
    yield "random", [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    yield "negative", [(-5, 9), (9, -7), (3, 4), (4, 3), (-(1 << 63), (1 << 63) - 1)]


@pytest.mark.parametrize("name,edges", list(cases()), ids=[n for n, _ in cases()])
def test_components(spark, name, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = by_hand([(a, b) for a, b in edges if a != b])
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_linked_loses_no_link(spark):
    """Numbers link if they differ by at most 3; buckets hold many more."""
    rng = random.Random(8)
    nodes = rng.sample(range(4000), 700)
    rows = [(x // 400, x, float(rng.randrange(5)), x) for x in nodes] + [((x + 200) // 400 + 1000, x, 0.0, x) for x in nodes]
    def near(pairs):
        return pairs.filter(F.abs(F.col("a") - F.col("b")) <= 3)

    found = linked(
        spark.createDataFrame(rows, "bucket long, node long, rank double, trait long"), lambda a, b: F.abs(a - b) <= 50, near, near
    )
    got = {r.node: r.label for r in found.collect()}
    want = by_hand([(a, b) for a in nodes for b in nodes if a < b <= a + 3])
    assert got == want


def test_large_clique_is_not_expanded(spark):
    """All nodes of one bucket link: about as many pairs as nodes are tested."""
    tested = []

    def count(pairs):
        tested.append(pairs.count())
        return pairs

    rows = spark.range(2000).select(
        F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"), F.lit(0.0).alias("rank"), F.lit(0).cast("long").alias("trait")
    )
    found = linked(rows, lambda a, b: F.lit(True), count, count)
    assert found.agg(F.countDistinct("label"), F.count("*")).first()[:] == (1, 2000)
    assert sum(tested) < 2100
