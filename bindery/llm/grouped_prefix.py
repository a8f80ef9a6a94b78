"""N-gram Jaccard join by grouped prefixes.

Two documents link if their shingle sets have a Jaccard similarity of at least
``PERCENT``. Documents with one set are one node from the start. The rest goes
by the prefix principle: sets that similar share a shingle among their first
few in any common order.

1. *Screen.* In hash order, linked sets share at least l of their first
   ``size - overlap + l`` shingles. Sets with fewer shingles in common with any
   other set drop out; most of a corpus does.
2. *Prefixes* of those left, in order of document frequency: shingles of one
   set only come first and match nothing, so what is left is short and rare.
3. *Groups.* Sets of one size and one prefix become a group; a member that does
   not link with the group's first one becomes a group of its own.
4. *Group pairs* that share a prefix shingle and fit in size are expanded and
   their members verified exactly (see ``linkage.linked`` for how hot shingles
   and large groups of near copies avoid all pairs).

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from bindery.llm.linkage import linked
from bindery.llm.rows import free_name, row_key, same_key, small_batches, written

SHINGLE, PERCENT = 5, 80
PART_TOKENS, PART_SETS, BATCH_TOKENS = 500_000, 20_000, 500_000
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each lower-cased (A-Z) word between ASCII white space."""
    words = text.encode("utf-8").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one without words none."""
    words = word_hashes(text)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(words.tobytes())], np.uint64) if len(words) else words
    x = words[: len(words) - size + 1] * MULTIPLIERS[0]
    for i in range(1, size):
        factor = MULTIPLIERS[i % 5] ^ np.uint64(i // 5)
        x = (x ^ (x >> np.uint64(29))) + words[i : len(words) - size + 1 + i] * factor
    x ^= x >> np.uint64(33)
    x *= MULTIPLIERS[1]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def least_overlap(n: int) -> int:
    """Shingles that a set of ``n`` shares with any set it links with, at least."""
    return -(-PERCENT * n // 100)


def screen_length(n: int) -> int:
    return max(1, -(-n // 10))


def in_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


SET = StructType().add("set_id", LongType()).add("n_shingles", LongType()).add("prefix", BinaryType())


@F.pandas_udf(SET)
def screened_set(texts: pd.Series) -> pd.DataFrame:
    """Id and size of the shingle set, and its first shingles in hash order."""
    out = []
    for text in texts:
        s = shingle_set(text)
        n = len(s)
        prefix = s[: n - least_overlap(n) + screen_length(n)]
        out.append((xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), n, prefix.tobytes()))
    return pd.DataFrame(out, columns=SET.names, index=texts.index)


@F.pandas_udf(ArrayType(LongType()))
def whole_set(texts: pd.Series) -> pd.Series:
    return pd.Series([in_long(shingle_set(t)) for t in texts], index=texts.index)


PACKED = (
    StructType()
    .add("part", LongType())
    .add("lone", BinaryType())
    .add("owner", BinaryType())
    .add("common", BinaryType())
    .add("ids", BinaryType())
    .add("counts", BinaryType())
)
COUNTED = StructType().add("part", LongType()).add("ids", BinaryType()).add("counts", BinaryType())
SHARED = StructType().add("set_id", LongType()).add("shared", LongType())


def in_portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in portions of bounded size."""
    portion = batch["prefix"].map(len).cumsum() // (8 * BATCH_TOKENS)
    for _, rows in batch.groupby(portion):
        yield rows


def packer(parts: int):
    """Per batch each prefix shingle once, packed by part.

    A shingle that several sets of the batch have is shared already: it is
    counted here and sent without owners, so a frequent one costs one entry
    per batch.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (x for b in batches for x in in_portions(b.drop_duplicates("set_id"))):
            ids = batch["set_id"].to_numpy(np.int64)
            each = [np.frombuffer(b, np.uint64) for b in batch["prefix"]]
            owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
            values, first, back, count = np.unique(
                np.concatenate(each), return_index=True, return_inverse=True, return_counts=True
            )
            local = np.bincount(owner[(count > 1)[back]], minlength=len(ids))
            part = (values % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = []
            for place in np.split(order, cuts[1:]) if len(order) else []:
                lone = place[count[place] == 1]
                rows.append(
                    (
                        int(part[place[0]]),
                        values[lone].tobytes(),
                        ids[owner[first[lone]]].tobytes(),
                        values[place[count[place] > 1]].tobytes(),
                        b"",
                        b"",
                    )
                )
            some = local > 0
            if some.any():
                rows.append((int(ids[0] % parts), b"", b"", b"", ids[some].tobytes(), local[some].astype(np.int64).tobytes()))
            yield pd.DataFrame(rows, columns=PACKED.names)

    return pack


def joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def shared_counter(parts: int):
    """Counts of one part's shingles, packed by the part that adds a set's counts up."""

    def count_shared(part: pd.DataFrame) -> pd.DataFrame:
        """For each set how many of this part's shingles another set has too (or more than that)."""
        lone, owner = joined(part["lone"], np.uint64), joined(part["owner"], np.int64)
        order = np.lexsort((owner, lone))
        lone, owner = lone[order], owner[order]
        new = np.ones(len(lone), bool)
        new[1:] = (lone[1:] != lone[:-1]) | (owner[1:] != owner[:-1])
        lone, owner = lone[new], owner[new]
        shared = np.isin(lone, joined(part["common"], np.uint64))
        twice = lone[1:] == lone[:-1]
        shared[1:] |= twice
        shared[:-1] |= twice
        found, n = np.unique(owner[shared], return_counts=True)
        ids = np.concatenate([found, joined(part["ids"], np.int64)])
        counts = np.concatenate([n, joined(part["counts"], np.int64)])
        to = ids % parts
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        rows = [(int(to[x[0]]), ids[x].tobytes(), counts[x].tobytes()) for x in np.split(order, cuts[1:]) if len(x)]
        return pd.DataFrame(rows, columns=COUNTED.names)

    return count_shared


def add_up(part: pd.DataFrame) -> pd.DataFrame:
    ids, back = np.unique(joined(part["ids"], np.int64), return_inverse=True)
    return pd.DataFrame({"set_id": ids, "shared": np.bincount(back, joined(part["counts"], np.int64), len(ids)).astype(np.int64)})


def screened(sets: DataFrame) -> DataFrame:
    """Ids of the sets that may link with another one."""
    tokens, rows = sets.agg(F.coalesce(F.sum(F.length("prefix")) / 8, F.lit(0)), F.count(F.lit(1))).first()
    shared = (
        sets.select("set_id", "prefix")
        .mapInPandas(packer(int(tokens // PART_TOKENS) + 1), PACKED)
        .groupBy("part")
        .applyInPandas(shared_counter(int(rows // PART_SETS) + 1), COUNTED)
        .groupBy("part")
        .applyInPandas(add_up, SHARED)
    )
    sizes = sets.groupBy("set_id").agg(F.first("n_shingles").alias("n"))
    least = F.ceil(PERCENT * F.col("n") / 100)
    return shared.join(sizes, "set_id").filter(F.col("shared") >= F.greatest(F.ceil(least / 10), F.lit(1))).select("set_id", "n")


def with_prefixes(whole: DataFrame) -> DataFrame:
    """(set_id, n, rare, prefix) of the sets whose rare shingles leave room for a match.

    ``rare`` counts the shingles that no other set has; they come first in the order.
    """
    tokens = whole.select("set_id", F.explode("shingles").alias("h"))
    frequency = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = (
        tokens.join(frequency, "h").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("common"))
    )
    room = F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1 - (F.col("n") - F.size("common"))
    return (
        whole.select("set_id", "n")
        .join(common, "set_id")
        .filter(room > 0)
        .select(
            "set_id",
            "n",
            (F.col("n") - F.size("common")).alias("rare"),
            F.slice(F.col("common")["h"], F.lit(1), room.cast("int")).alias("prefix"),
        )
    )


def similar(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def may_link(a: Column, b: Column) -> Column:
    """Sizes fit, and enough shingles are left from the first one in common on.

    Each side is (n, place): set size, and how many shingles come before this one.
    The test holds for the first common shingle of any two linked sets.
    """
    sizes = 100 * F.least(a["n"], b["n"]) >= PERCENT * F.greatest(a["n"], b["n"])
    left = F.least(a["n"] - a["place"], b["n"] - b["place"])
    return sizes & ((100 + PERCENT) * left >= PERCENT * (a["n"] + b["n"]))


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (x, y and others) whose sets x and y are similar."""
    left = whole.select(F.col("set_id").alias("x"), F.col("shingles").alias("x_set"))
    right = whole.select(F.col("set_id").alias("y"), F.col("shingles").alias("y_set"))
    return pairs.join(left, "x").join(right, "y").filter(similar(F.col("x_set"), F.col("y_set"))).select(*pairs.columns)


def set_labels(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, label) of the sets that link with another one."""
    candidates = screened(sets)
    chosen = (
        sets.join(candidates, "set_id")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "row_key")).alias("of"), F.first("n").alias("n"))
        .select("set_id", "n", F.col("of")["doc_id"].alias("doc_id"), F.col("of")["row_key"].alias("row_key"))
    )
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    whole = written(
        texts.join(chosen, same_key(texts, chosen, "doc_id", "row_key"))
        .dropDuplicates(["set_id"])
        .select("set_id", "n", whole_set("text").alias("shingles")),
        "shingles",
    )
    prefixes = written(with_prefixes(whole), "prefixes")
    whole = written(whole.join(prefixes.select("set_id"), "set_id"), "linkable")

    # Groups of one size and prefix; those that differ from the first member leave.
    alike = prefixes.groupBy("n", "prefix").agg(F.min("set_id").alias("leader"), F.count(F.lit(1)).alias("members"))
    grouped = prefixes.join(alike, ["n", "prefix"]).select("set_id", "n", "rare", "prefix", "leader", "members")
    inside = grouped.filter("members > 1 and set_id <> leader").select(F.col("set_id").alias("x"), F.col("leader").alias("y"))
    stay = verified(inside, whole).select(F.col("x").alias("set_id"), F.col("y").alias("stay_with"))
    members = written(
        grouped.join(stay, "set_id", "left").select("set_id", "n", "rare", "prefix", F.coalesce("stay_with", "set_id").alias("node")),
        "groups",
    )
    # A text that others were copied from has few rare shingles: it is compared first.
    buckets = (
        members.filter("set_id = node")
        .select("node", "n", "rare", F.posexplode("prefix").alias("i", "bucket"))
        .select(
            "bucket",
            "node",
            (F.col("rare") / F.col("n")).alias("rank"),
            F.struct("n", (F.col("rare") + F.col("i")).alias("place")).alias("trait"),
        )
    )

    def leaders(pairs: DataFrame) -> DataFrame:
        return verified(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), whole).select("a", "b")

    def all_members(pairs: DataFrame) -> DataFrame:
        of = members.select("node", "set_id")
        expanded = pairs.join(of.select(F.col("node").alias("a"), F.col("set_id").alias("x")), "a").join(
            of.select(F.col("node").alias("b"), F.col("set_id").alias("y")), "b"
        )
        return verified(expanded, whole).select("a", "b").distinct()

    labels = linked(buckets, may_link, leaders, all_members)
    return (
        members.select("set_id", "node")
        .join(labels, "node", "left")
        .select("set_id", F.coalesce("label", "node").alias("label"))
    )


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, chosen) for each row of ``docs``.

    ``component_id`` is the least doc_id reachable by links, its own included;
    a null id is never the least unless no other is there. ``chosen`` is true
    for the documents of the component that have its least (doc_id, row_key);
    rows that repeat id and text are alike. Null texts and texts without words
    have no shingles, link with nothing and are chosen. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = F.col("found")
    sets = written(
        docs.select("doc_id", row_key().alias("row_key"), screened_set("text").alias("found")).select(
            "doc_id", "row_key", found["set_id"].alias("set_id"), found["n_shingles"].alias("n_shingles"), found["prefix"].alias("prefix")
        ),
        "sets",
    )
    some = sets.filter("n_shingles > 0")
    labels = set_labels(docs, some)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    per_set = some.groupBy("set_id").agg(least.alias("least"))
    per_set = written(
        per_set.join(labels, "set_id", "left").select("set_id", F.coalesce("label", "set_id").alias("label"), "least"), "per-set"
    )
    per_label = per_set.groupBy("label").agg(F.min("least").alias("least"))
    best = per_set.select("set_id", "label").join(per_label, "label").select("set_id", "least")
    kept = F.col("least").isNull() | (
        F.col("least")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("least")["row_key"] == F.col("row_key"))
    )
    return (
        sets.select("doc_id", "row_key", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"), "n_shingles")
        .join(best, "set_id", "left")
        .select(
            "doc_id",
            "row_key",
            "n_shingles",
            F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least")["doc_id"]).alias("component_id"),
            kept.alias("chosen"),
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicate_groups(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, unchanged: that of the least id."""
    others = near_duplicate_groups(docs).filter(~F.col("chosen"))
    others = others.select(F.col("doc_id").alias("other_id"), F.col("row_key").alias("other_key")).distinct()
    key = free_name(docs, "_group_key")
    keyed = docs.select(*docs.columns, row_key().alias(key))
    left = keyed.join(
        others, keyed["doc_id"].eqNullSafe(others["other_id"]) & (keyed[key] == others["other_key"]), "left_anti"
    )
    # Rows that repeat id and text are one document, unless it has no words.
    wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    once = left.filter(~wordless).dropDuplicates(["doc_id", key])
    return once.unionByName(left.filter(wordless)).select(*docs.columns)
