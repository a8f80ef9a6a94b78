"""Nearest neighbours through a few stable projections and kd-trees.

Inner product becomes Euclidean distance by one more component: a vector x gets
sqrt(M^2 - |x|^2), with M the largest norm, and a query gets 0. Each point is
then projected on ``DIMS`` Gaussian directions. Gaussians are 2-stable: the
squared projected distance over the squared distance follows a chi-square law
with ``DIMS`` degrees of freedom, whatever the data. So points are verified in
order of projected distance, and once that distance exceeds the chi-square
quantile ``SURE`` times the distance of the k-th best so far, a nearer point has
been missed with a probability of at most 1 - ``SURE`` (Sun and others, 2014).

A kd-tree over the projections gives that order. Its upper levels, fitted on a
bounded sample, cut the points into cells; cells are stored in blocks of bounded
size, each with the tree's lower levels. A query first searches one block of its
own cell, then every block that the stopping test cannot rule out. Equal vectors
are one point with their least ids, so a vector that many rows share costs one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructType,
)

from bindery.llm.rows import written

DIMS, SURE = 8, 0.95
SAMPLE, CELL_ROWS, BLOCK_ROWS, LEAF, QUERIES = 20_000, 8192, 8192, 64, 2048
SEED = 11


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """For an even number of degrees of freedom."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((DIMS, size + 1))


def as_matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float32).reshape(len(vectors), -1)


def projected(vectors: np.ndarray, largest: float | None) -> np.ndarray:
    """Points if ``largest`` is the largest norm, queries if it is None."""
    x = vectors.astype(np.float64)
    extra = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))
    axes = directions(x.shape[1])
    return x @ axes[:, :-1].T + extra[:, None] * axes[:, -1]


def kd_order(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree's leaves: the points' order, and where each leaf starts."""
    out, starts, stack, done = [], [], [np.arange(len(points))], 0
    while stack:
        own = stack.pop()
        if len(own) <= leaf:
            out.append(own)
            starts.append(done)
            done += len(own)
            continue
        x = points[own]
        axis = int((x.max(0) - x.min(0)).argmax())
        half = len(own) // 2
        own = own[np.argpartition(x[:, axis], half)]
        stack += [own[half:], own[:half]]
    return np.concatenate(out), np.array(starts)


def upper_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of the splits of a full binary tree over the sample, in heap order."""
    axes, values = np.zeros(2**depth, np.int64), np.zeros(2**depth)
    held = {1: sample}
    for node in range(1, 2**depth):
        x = held.pop(node)
        if len(x):
            axes[node] = (x.max(0) - x.min(0)).argmax()
            values[node] = np.median(x[:, axes[node]])
        right = x[:, axes[node]] > values[node]
        held[2 * node], held[2 * node + 1] = x[~right], x[right]
    return axes, values


def cells_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axes, values = tree
    at = np.ones(len(points), np.int64)
    for _ in range(int(math.log2(len(axes)))):
        at = 2 * at + (points[np.arange(len(points)), axes[at]] > values[at])
    return at - len(axes)


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to boxes, 0 inside."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(-1)


BLOCK = (
    StructType()
    .add("block_id", LongType())
    .add("cell", IntegerType())
    .add("n", IntegerType())
    .add("low", ArrayType(DoubleType()))
    .add("high", ArrayType(DoubleType()))
    .add("keys", BinaryType())
    .add("vectors", BinaryType())
    .add("starts", BinaryType())
    .add("leaf_low", BinaryType())
    .add("leaf_high", BinaryType())
)


def block_builder(largest: float):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        """One row for the block: its points in kd order, and the leaves' boxes."""
        group = group.sort_values("key")
        vectors = as_matrix(group["vector"])
        points = projected(vectors, largest)
        order, starts = kd_order(points, LEAF)
        points = points[order]
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        first = group.iloc[0]
        row = (
            int(first["cell"]) << 32 | int(first["salt"]),
            int(first["cell"]),
            len(group),
            low.min(0),
            high.max(0),
            group["key"].to_numpy(np.int64)[order].tobytes(),
            vectors[order].tobytes(),
            starts.tobytes(),
            low.tobytes(),
            high.tobytes(),
        )
        return pd.DataFrame([row], columns=BLOCK.names)

    return build


class Block:
    """A block row unpacked; ``search`` verifies leaves in order of projected distance."""

    def __init__(self, row, size: int, largest: float):
        self.keys = np.frombuffer(row["held_keys"], np.int64)
        self.vectors = np.frombuffer(row["held_vectors"], np.float32).reshape(-1, size).astype(np.float64)
        self.starts = np.append(np.frombuffer(row["held_starts"], np.int64), len(self.keys))
        self.low = np.frombuffer(row["held_leaf_low"]).reshape(-1, DIMS)
        self.high = np.frombuffer(row["held_leaf_high"]).reshape(-1, DIMS)
        self.largest2 = largest**2

    def search(self, query: np.ndarray, point: np.ndarray, k: int, limit: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Keys and inner products of up to ``k`` best; ``radius`` is a squared distance that k points elsewhere keep."""
        far = box_distance(point, self.low, self.high)
        order = np.argsort(far, kind="stable")
        far, q2 = far[order], self.largest2 + query @ query
        keys, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 8
        while at < len(order) and far[at] <= limit * radius:
            rows = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in order[at : at + step]])
            keys = np.append(keys, self.keys[rows])
            scores = np.append(scores, self.vectors[rows] @ query)
            best = np.lexsort((keys, -scores))[:k]
            keys, scores = keys[best], scores[best]
            if len(scores) == k:
                radius = min(radius, max(q2 - 2 * scores[-1], 0.0))
            at += step
        return keys, scores


FOUND = StructType().add("query", LongType()).add("key", LongType()).add("score", DoubleType())


def block_search(size: int, largest: float, k: int, limit: float):
    def search(_, visits: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(visits) and len(blocks):
            block = Block(blocks.iloc[0], size, largest)
            queries = as_matrix(visits["vector"])
            points = projected(queries, None)
            for q, query, point, radius in zip(visits["query"], queries.astype(np.float64), points, visits["radius"]):
                keys, scores = block.search(query, point, k, limit, radius)
                out.append(pd.DataFrame({"query": np.int64(q), "key": keys, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": "int64", "key": "int64"})

    return search


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k).drop("_nth")


def searched(visits: DataFrame, blocks: DataFrame, search) -> DataFrame:
    """``visits`` (query, vector, radius, block_id) against their blocks, in portions of bounded size."""
    portions = written(
        visits.groupBy("block_id").agg(F.floor(F.count(F.lit(1)) / QUERIES).cast("int").alias("portions")), "portions"
    )
    asked = visits.join(portions, "block_id").select(
        "query", "vector", "radius", "block_id", F.pmod(F.xxhash64("query"), F.col("portions") + 1).cast("int").alias("portion")
    )
    copies = portions.select("block_id", F.explode(F.sequence(F.lit(0), F.col("portions"))).alias("copy"))
    held = blocks.join(copies, "block_id").select(*[F.col(c).alias(f"held_{c}") for c in blocks.columns], "copy")
    return (
        asked.groupBy("block_id", "portion").cogroup(held.groupBy("held_block_id", "copy")).applyInPandas(search, FOUND)
    )


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by inner product that are found for each query.

    ``rows`` has vec_id and embedding; ``is_query`` is a condition on vec_id. All
    rows are candidates but the query's own id; ties go to the smaller id. No part
    take null ids and vectors that are null, zero, hold null or non-finite
    components, or are not of the commonest length. Of rows that repeat an id the
    least vector counts. Fewer candidates than ``k`` give fewer rows. Scores are
    inner products of the original vectors in double precision.
    """
    spark = rows.sparkSession
    good = rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 1
    one = good.filter(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("vector"))
    # A vector's first k + 1 ids are enough: one of them may be the query's own.
    same = Window.partitionBy("vector").orderBy("vec_id")
    one = written(one, "vectors")
    few = one.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    points = written(
        few.groupBy("vector").agg(F.min("vec_id").alias("key"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "points"
    )
    norm2 = F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, largest = points.agg(F.count(F.lit(1)), F.max(F.sqrt(norm2))).first()
    largest = float(largest or 0.0)

    # The upper tree is fitted on at most SAMPLE points, picked by hash.
    sample = points.orderBy(F.xxhash64("key")).limit(SAMPLE).select("vector").toPandas()
    depth = max(0, math.ceil(math.log2(min(max(count, 1), CELL_ROWS * SAMPLE // 32) / CELL_ROWS)))
    fitted = projected(as_matrix(sample["vector"]), largest) if len(sample) else np.zeros((0, DIMS))
    tree = spark.sparkContext.broadcast(upper_tree(fitted, depth))

    @F.pandas_udf(IntegerType())
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells_of(projected(as_matrix(vectors), largest), tree.value), index=vectors.index)

    placed = points.select("key", "vector", cell("vector").alias("cell"))
    counts = placed.groupBy("cell").agg(F.floor((F.count(F.lit(1)) - 1) / BLOCK_ROWS).cast("int").alias("salts"))
    blocks = written(
        placed.join(counts, "cell")
        .withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts") + 1).cast("int"))
        .groupBy("cell", "salt")
        .applyInPandas(block_builder(largest), BLOCK),
        "blocks",
    )

    # Boxes of cells, not of blocks: their number is bounded by the sample.
    def extreme(name: str, of) -> Column:
        return F.array(*[of(F.col(name)[i]) for i in range(DIMS)]).alias(name)

    boxes = blocks.groupBy("cell").agg(
        extreme("low", F.min), extreme("high", F.max), F.collect_list("block_id").alias("ids")
    ).select("cell", "low", "high").orderBy("cell").collect()
    low, high = (np.array([r[i] for r in boxes]).reshape(-1, DIMS) for i in (1, 2))
    shared = spark.sparkContext.broadcast((np.array([r["cell"] for r in boxes], np.int32), low, high))
    limit = chi_square_quantile(sure)

    @F.pandas_udf(IntegerType())
    def home(vectors: pd.Series) -> pd.Series:
        cells, low, high = shared.value
        asked = projected(as_matrix(vectors), None)
        return pd.Series([int(cells[box_distance(p, low, high).argmin()]) for p in asked], index=vectors.index)

    @F.pandas_udf(ArrayType(IntegerType()))
    def reachable(vectors: pd.Series, radius: pd.Series) -> pd.Series:
        cells, low, high = shared.value
        asked = projected(as_matrix(vectors), None)
        return pd.Series(
            [cells[box_distance(p, low, high) <= limit * r] for p, r in zip(asked, radius)], index=vectors.index
        )

    ids = one.filter(is_query).select("vec_id", "vector")
    queries = written(
        ids.groupBy("vector").agg(F.min("vec_id").alias("query")).withColumn("home", home("vector")), "queries"
    )
    search = block_search(size, largest, k + 1, limit)
    of_cell = blocks.select("cell", "block_id")
    first_block = of_cell.groupBy("cell").agg(F.min("block_id").alias("block_id"))
    everywhere = F.lit(float("inf"))
    first = written(
        searched(
            queries.join(first_block, F.col("home") == F.col("cell")).select(
                "query", "vector", everywhere.alias("radius"), "block_id"
            ),
            blocks,
            search,
        ),
        "first-found",
    )
    kept = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    reach = F.when(F.col("n") > k, F.greatest(F.lit(largest**2) + norm2 - 2 * F.col("least"), F.lit(0.0))).otherwise(everywhere)
    asked = queries.join(kept, "query", "left").select("query", "vector", "home", reach.alias("radius"))
    done = first_block.select(F.col("block_id").alias("done_id"), F.col("cell").alias("done_cell"))
    visits = (
        asked.select("query", "vector", "home", "radius", F.explode(reachable("vector", "radius")).alias("cell"))
        .join(of_cell, "cell")
        .join(done, F.col("home") == F.col("done_cell"))
        .filter("block_id <> done_id")
        .select("query", "vector", "radius", "block_id")
    )
    found = best_of(first.unionByName(searched(visits, blocks, search)), k + 1)
    by_vector = (
        found.join(points.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("key"))
    )
    lists = (
        best_of(by_vector, k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("key").alias("vec_id")))).alias("list"))
    )
    asking = ids.select(F.col("vec_id").alias("query_id"), "vector").join(queries.select("vector", "query"), "vector")
    own = F.filter("list", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        asking.join(lists, "query")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("nth", "hit"))
        .select(
            "query_id",
            (F.col("nth") + 1).cast("int").alias("rank"),
            F.col("hit")["vec_id"].alias("vec_id"),
            (-F.col("hit")["far"]).alias("score"),
        )
    )


def digest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
