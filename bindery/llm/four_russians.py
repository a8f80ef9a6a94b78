"""Hard-negative mining: every anchor against every vector by Four-Russians scoring.

Components become integers, and a candidate's integers become bit planes: for each
bit of two's complement and each group of eight dimensions one byte. An anchor has,
for each group, a table of the 256 sums of subsets of its eight components. So
an inner product is a sum of table entries that the plane's bytes index, shifted by
the bit's place and added; the sign's plane is subtracted. Scores are exact.

Anchors and candidates are dealt by hash into blocks of a fixed size, whatever
their labels, and every block of anchors meets every block of candidates once. A
block pair gives out at most ``POSITIVES`` or ``NEGATIVES`` rows for a question,
and a ranking over these gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.llm.rows import written

SCALE, LIMIT = 256, 2**24
POSITIVES, NEGATIVES = 5, 3
ANCHOR_BLOCK, CANDIDATE_BLOCK, STRIP = 512, 4096, 256


def planes_of(q: np.ndarray) -> np.ndarray:
    """Bit planes of integers (n, 8 * groups) as bytes (n, planes, groups); the last plane is the sign's."""
    low, high = int(min(q.min(initial=0), -1)), int(max(q.max(initial=0), 0))
    planes = max(high.bit_length(), (-low - 1).bit_length()) + 1
    bits = (q[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def integers_of(packed: np.ndarray) -> np.ndarray:
    """The integers of ``planes_of``."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(packed.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("npd,p->nd", bits, weights)


def unpacked(column: pd.Series, groups: int) -> np.ndarray:
    """Rows of packed planes as one array; rows with fewer planes repeat their sign's."""
    rows = [np.frombuffer(b, np.uint8).reshape(-1, groups) for b in column]
    planes = max((len(r) for r in rows), default=1)
    return np.stack([np.concatenate([r, np.repeat(r[-1:], planes - len(r), axis=0)]) for r in rows])


class SubsetSums:
    """Tables of the anchors' subset sums, and scores of candidates by lookups."""

    def __init__(self, anchors: np.ndarray):
        n, d = anchors.shape
        self.largest = int(np.abs(anchors).sum(1).max(initial=1))
        tables = np.zeros((d // 8, 256, n), np.int64)
        for bit in range(8):
            tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + anchors[:, bit::8].T[:, None, :]
        self.tables = tables

    def scores(self, packed: np.ndarray) -> np.ndarray:
        """(candidates, anchors) inner products."""
        n, planes, groups = packed.shape
        kind = np.int32 if self.largest << planes < 2**31 else np.int64
        tables = self.tables.astype(kind)
        out = np.empty((n, tables.shape[2]), kind)
        for start in range(0, n, STRIP):
            strip = packed[start : start + STRIP]
            total = np.zeros((len(strip), tables.shape[2]), kind)
            for plane in range(planes - 1, -1, -1):
                total <<= 1
                found = tables[0][strip[:, plane, 0]]
                for g in range(1, groups):
                    found += tables[g][strip[:, plane, g]]
                total = total - found if plane == planes - 1 else total + found
            out[start : start + STRIP] = total
        return out


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """A written table (row, vec_id, label, planes) of what takes part, and the number of groups."""
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    dims = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    groups = max(1, -(-dims // 8))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((len(sizes), groups * 8))
            x[np.arange(groups * 8) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * x)
            if len(x) and np.abs(x).max() >= LIMIT:
                raise ValueError(f"components times {SCALE} must stay below {LIMIT}")
            packed = planes_of(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([p.tobytes() for p in packed], pa.binary())],
                names=["vec_id", "label", "planes"],
            )

    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), relabelled.cast("long").alias("label"), "embedding")
    table = rows.mapInArrow(pack, "vec_id long, label long, planes binary")
    return written(table.withColumn("row", F.monotonically_increasing_id()), "planes"), groups


def in_blocks(anchors: DataFrame, candidates: DataFrame):
    """Every block of anchors with every block of candidates."""
    a_blocks = -(-anchors.count() // ANCHOR_BLOCK)
    c_blocks = -(-candidates.count() // CANDIDATE_BLOCK)

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))).cast("int")
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may come from one table
        return fresh.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(others, 1) - 1))))

    left = dealt(anchors, "a_block", a_blocks, "c_block", c_blocks)
    right = dealt(candidates, "c_block", c_blocks, "a_block", a_blocks)
    return left.groupBy("a_block", "c_block").cogroup(right.groupBy("a_block", "c_block"))


def ordered(scores: np.ndarray) -> np.ndarray:
    """Places by falling score; equal scores stay in their order."""
    return np.argsort(-scores, kind="stable")


def best_of_label(groups: int, count: int):
    def search(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        candidates = candidates.sort_values(["vec_id", "row"])
        for label, some in anchors.groupby("label"):
            same = candidates[candidates["label"] == label]
            if same.empty:
                continue
            scores = SubsetSums(integers_of(unpacked(some["planes"], groups))).scores(unpacked(same["planes"], groups))
            rows, ids = same["row"].to_numpy(), same["vec_id"].to_numpy()
            for i, own in enumerate(some["row"]):
                places = ordered(scores[:, i])[: count + 1]
                places = places[rows[places] != own][:count]
                out += [(own, rows[p], ids[p], int(scores[p, i])) for p in places]
        return pd.DataFrame(out, columns=["anchor", "other", "positive_id", "positive_score"])

    return search


def best_below(groups: int, count: int):
    """For each asked positive score, the best candidates of other labels in its range."""

    def search(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(candidates):
            candidates = candidates.sort_values(["vec_id", "row"])
            rows, ids, labels = (candidates[c].to_numpy() for c in ("row", "vec_id", "label"))
            scores = SubsetSums(integers_of(unpacked(anchors["planes"], groups))).scores(unpacked(candidates["planes"], groups))
            for i, (own, label, asked) in enumerate(zip(anchors["row"], anchors["label"], anchors["asked"])):
                other = np.flatnonzero(labels != label)
                places = other[ordered(scores[other, i])]
                falling = scores[places, i].astype(np.int64)
                for positive in map(int, asked):
                    # 100 * score <= 95 * positive and 100 * score >= 50 * positive
                    first = np.searchsorted(-falling, -((95 * positive) // 100))
                    end = np.searchsorted(-falling, (-50 * positive) // 100, side="right")
                    out += [(own, positive, rows[p], ids[p], int(scores[p, i])) for p in places[first : min(end, first + count)]]
        return pd.DataFrame(out, columns=["anchor", "positive_score", "other", "negative_id", "negative_score"])

    return search


def mine(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector or a null or non-finite component take no
    part. A shorter vector counts as filled up with zeros. Rows that repeat are rows
    of their own: each is an anchor, a positive or a negative for the others. Ties go
    to the smaller vec_id. A component beyond ``LIMIT`` after scaling is an error.
    Empty tables give no rows; extra columns are ignored.
    """
    table, groups = prepared(vectors.select("vec_id", "label", "embedding"))
    candidates = table.select("row", "vec_id", "label", "planes")
    anchors = candidates.filter(F.col("vec_id") % every == 0)

    found = in_blocks(anchors.select("row", "label", "planes"), candidates).applyInPandas(
        best_of_label(groups, positives), "anchor long, other long, positive_id long, positive_score long"
    )
    nearest = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "other")
    pairs = written(found.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= positives).drop("n"), "positives")

    asked = pairs.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))
    below = in_blocks(anchors.join(asked, "row").select("row", "label", "planes", "asked"), candidates).applyInPandas(
        best_below(groups, negatives), "anchor long, positive_score long, other long, negative_id long, negative_score long"
    )
    hardest = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "other")
    ranked = below.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        pairs.join(ranked, ["anchor", "positive_score"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def digest(vectors: DataFrame) -> DataFrame:
    return mine(vectors)
