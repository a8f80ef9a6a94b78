"""Substring dedup: repeated runs of words found with suffix automata.

A window of ``WINDOW`` words goes if it also starts in a document with a smaller
id. Which documents to compare is found by anchors: of a window's ``GRAM``-word
pieces the least hash is its anchor. Equal windows have
equal anchors, so all that can match shares one. Neighbouring windows with one
anchor form a segment.

1. Anchors that only one document has drop out, and with them most text. Equal
   segments of an anchor become one, owned by the least document id; every
   other document that has it loses it whole.
2. Where an anchor has different segments, these are trimmed to the windows that
   several of them have. What is left, reference spans, is cut into shards of
   bounded size by anchor, and a suffix automaton is built for each shard. Its
   states know the least document that holds their words.
3. The automata are sent to the spans of their shard, which are streamed through:
   matching statistics give at each word the longest match that ends there, and
   a match of ``WINDOW`` words or more the least document holding the window.
   Spans of an owner that a smaller document has go as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from bindery.llm.rows import row_key, same_key, written

WINDOW, GRAM = 50, 10
SHARD_WORDS, PORTION_WORDS, PORTION_PIECES = 40_000, 200_000, 2_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any runs of a word sequence, by prefix sums modulo 2^64."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        grow = np.full(n + 1, BASE, np.uint64)
        back = np.full(n + 1, INVERSE, np.uint64)
        grow[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(grow)[:n])])

    def run(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        part = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mixed(part + np.asarray(length, np.uint64) * np.uint64(0xA0761D6478BD642F))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :])


def segments(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, number of windows, hash of the words) of each segment of each text.

    All texts are worked on as one sequence; windows that cross from one text
    into the next are left out.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    if sizes.sum() < WINDOW:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    hashes = Hashes(list(chain.from_iterable(texts)))
    total = int(sizes.sum())
    anchor = sliding_least(hashes.run(np.arange(total - GRAM + 1), GRAM), WINDOW - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(owner[: len(anchor)] == owner[WINDOW - 1 :])
    anchor, owner = anchor[inside], owner[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(new)
    first, count = inside[cut], np.diff(cut, append=len(inside))
    return owner[cut], anchor[cut], first - starts[owner[cut]], count, hashes.run(first, count + WINDOW - 1)


MARK = StructType().add("anchor", LongType()).add("first", IntegerType()).add("n", IntegerType()).add("segment", LongType())


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of consecutive texts in portions of bounded size, with the first text's place."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        words = split_words(text)
        if held and size + len(words) > PORTION_WORDS:
            yield start, held
            start, held, size = i, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield start, held


def list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in portions(batch.column("text").to_pylist()):
            text, anchor, first, count, segment = segments(texts)
            rows = pa.array((text + start).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("row_key").take(rows),
                    pa.array(anchor.view(np.int64)),
                    pa.array(first.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(segment.view(np.int64)),
                ],
                names=["doc_id", "row_key", *MARK.names],
            )


PIECE = (
    StructType()
    .add("anchor", LongType())
    .add("segment", LongType())
    .add("owner", LongType())
    .add("words", StringType())
    .add("windows", ArrayType(LongType()))
)


def cut_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each asked segment of a text: its words and the hashes of its windows."""
    out = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            words = split_words(row.text)
            hashes = Hashes(words)
            for anchor, segment, first, n in zip(row.anchors, row.segments, row.firsts, row.counts):
                text = b" ".join(words[first : first + n + WINDOW - 1]).decode("utf-8")
                windows = hashes.run(np.arange(first, first + n), WINDOW).view(np.int64)
                out.append((anchor, segment, row.owner, text, windows))
                if len(out) >= PORTION_PIECES:
                    yield pd.DataFrame(out, columns=PIECE.names)
                    out = []
    if out:
        yield pd.DataFrame(out, columns=PIECE.names)


class Automaton:
    """A suffix automaton over word sequences; each state knows the least owner of its words."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.owner.append(self.owner[like] if like is not None else None)
        return len(self.length) - 1

    def _split(self, at: int, word: str, old: int) -> int:
        """The state for the words that end in ``word`` after ``at``, apart from longer ones."""
        if self.length[old] == self.length[at] + 1:
            return old
        copy = self._state(self.length[at] + 1, like=old)
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = copy
            at = self.link[at]
        self.link[old] = copy
        return copy

    def add(self, words: list[str], owner: int) -> None:
        last = 0
        for word in words:
            old = self.next[last].get(word)
            if old is not None:  # known from an earlier sequence
                last = self._split(last, word, old)
            else:
                new, at = self._state(self.length[last] + 1), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, word, self.next[at][word])
                last = new
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> None:
        """Shorter suffixes occur wherever longer ones do."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up, owner = self.link[state], self.owner[state]
            if owner is not None and (self.owner[up] is None or owner < self.owner[up]):
                self.owner[up] = owner

    def least_owners(self, words: list[str]) -> list[int | None]:
        """For each window of ``WINDOW`` words the least owner that has it, by matching statistics."""
        state, length, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if i >= WINDOW - 1:
                holder = state
                if length >= WINDOW:
                    while self.length[self.link[holder]] >= WINDOW:
                        holder = self.link[holder]
                out.append(self.owner[holder] if length >= WINDOW else None)
        return out


RANGE = StructType().add("at", IntegerType()).add("n", IntegerType()).add("low", LongType())
RANGES = StructType().add("anchor", LongType()).add("words", StringType()).add("ranges", ArrayType(RANGE))


def match_shard(_, references: pd.DataFrame, streamed: pd.DataFrame) -> pd.DataFrame:
    """Ranges of windows of each streamed span with the least owner in this shard."""
    automaton, out = Automaton(), []
    if len(streamed):
        for words, owner in zip(references["words"], references["owner"]):
            automaton.add(words.split(" "), owner)
        automaton.finish()
    for anchor, words in zip(streamed["s_anchor"], streamed["s_words"]):
        ranges: list[dict] = []
        for i, low in enumerate(automaton.least_owners(words.split(" "))):
            if low is None:
                continue
            if ranges and ranges[-1]["low"] == low and ranges[-1]["at"] + ranges[-1]["n"] == i:
                ranges[-1]["n"] += 1
            else:
                ranges.append({"at": i, "n": 1, "low": low})
        out.append((anchor, words, ranges))
    return pd.DataFrame(out, columns=RANGES.names)


def matched(spans: DataFrame) -> DataFrame:
    """(anchor, words, ranges) for the distinct spans (anchor, words, owner).

    Small anchors share shards. One with more than ``SHARD_WORDS`` words is cut
    into several references and several streams, and each stream meets each
    reference; results are the least over the references.
    """
    sized = spans.withColumn("size", F.size(F.split("words", " ")))
    per_anchor = sized.groupBy("anchor").agg(F.sum("size").alias("total"))
    total = per_anchor.agg(F.sum("total")).first()[0] or 0
    shards = int(total // SHARD_WORDS) + 1
    cut = F.floor(F.col("total") / SHARD_WORDS).cast("int")
    shard = F.when(cut > 0, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(shards)))
    placed = sized.join(per_anchor, "anchor").select("anchor", "words", "owner", shard.alias("shard"), cut.alias("cut"))
    mine = F.pmod(F.xxhash64("words"), F.col("cut") + 1).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("cut")))
    references = placed.withColumn("part", mine).withColumn("stream", others).select("shard", "part", "stream", "words", "owner")
    streams = placed.withColumn("stream", mine).withColumn("part", others)
    streams = streams.select(*[F.col(c).alias(f"s_{c}") for c in ("shard", "part", "stream", "anchor", "words")])
    return (
        references.groupBy("shard", "part", "stream")
        .cogroup(streams.groupBy("s_shard", "s_part", "s_stream"))
        .applyInPandas(match_shard, RANGES)
    )


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, length) in words, 0-based, of what goes; ranges may overlap."""
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    schema = StructType([StructField("doc_id", LongType()), StructField("row_key", LongType()), *MARK.fields])
    marks = written(texts.mapInArrow(list_segments, schema), "segments")

    by_segment = marks.groupBy("anchor", "segment").agg(
        F.min(F.struct("doc_id", "row_key", "first")).alias("place"), F.max("doc_id").alias("high"), F.first("n").alias("n")
    )
    by_anchor = by_segment.groupBy("anchor").agg(
        F.min("place")["doc_id"].alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("segments")
    )
    owned = written(
        by_segment.drop("high")
        .join(by_anchor.filter("low < high").select("anchor", "segments"), "anchor")
        .select("anchor", "segment", "segments", "n", F.col("place")["doc_id"].alias("owner"), "place"),
        "owned",
    )
    whole = (
        marks.join(owned.select("anchor", "segment", "owner"), ["anchor", "segment"])
        .filter("doc_id > owner")
        .select("doc_id", "row_key", F.col("first").alias("start"), (F.col("n") + WINDOW - 1).alias("length"))
    )

    # Words and windows of the segments of anchors that have several.
    asked = (
        owned.filter("segments > 1")
        .groupBy(F.col("owner").alias("doc_id"), F.col("place")["row_key"].alias("row_key"))
        .agg(F.collect_list(F.struct("anchor", "segment", F.col("place")["first"].alias("first"), "n")).alias("asked"))
    )
    fields = {"anchors": "anchor", "segments": "segment", "firsts": "first", "counts": "n"}
    several = written(
        texts.join(asked, same_key(texts, asked, "doc_id", "row_key"))
        .select(texts["doc_id"].alias("owner"), "text", *[F.col("asked")[f].alias(name) for name, f in fields.items()])
        .mapInPandas(cut_pieces, PIECE)
        .dropDuplicates(["anchor", "segment"]),
        "several",
    )
    windows = several.select("anchor", "segment", F.posexplode("windows").alias("i", "window"))
    common = (
        windows.groupBy("anchor", "window")
        .agg(F.min("segment").alias("s1"), F.max("segment").alias("s2"))
        .filter("s1 <> s2")
        .select("anchor", "window")
    )
    order = Window.partitionBy("anchor", "segment").orderBy("i")
    trimmed = (
        windows.join(common, ["anchor", "window"])
        .select("anchor", "segment", "i", (F.col("i") - F.row_number().over(order)).alias("run"))
        .groupBy("anchor", "segment", "run")
        .agg(F.min("i").alias("i"), F.count(F.lit(1)).cast("int").alias("n"))
        .join(several.select("anchor", "segment", "owner", "words"), ["anchor", "segment"])
    )
    part = F.slice(F.split("words", " "), F.col("i") + 1, F.col("n") + WINDOW - 1)
    spans = written(trimmed.select("anchor", "segment", "owner", "i", F.array_join(part, " ").alias("words")), "spans")
    distinct = written(spans.groupBy("anchor", "words").agg(F.min("owner").alias("owner")), "references")
    inside = (
        matched(distinct)
        .select("anchor", "words", F.inline("ranges"))
        .join(spans, ["anchor", "words"])
        .filter("low < owner")
        .select("anchor", "segment", "owner", (F.col("i") + F.col("at")).alias("i"), "n")
    )
    partly = marks.withColumnRenamed("n", "windows").join(inside, ["anchor", "segment"]).filter("doc_id = owner").select(
        "doc_id", "row_key", (F.col("first") + F.col("i")).alias("start"), (F.col("n") + WINDOW - 1).alias("length")
    )
    return whole.union(partly)


KEPT = StructType().add("text", StringType()).add("n_words", LongType()).add("n_removed", LongType())


@F.pandas_udf(KEPT)
def without_ranges(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    out = []
    for text, start, length in zip(texts, starts, lengths):
        words = split_words(text)
        kept = words
        if start is not None and len(start):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.asarray(start), 1)
            np.add.at(change, np.asarray(start) + np.asarray(length), -1)
            stays = np.cumsum(change[:-1]) == 0
            kept = [w for w, s in zip(words, stays) if s]
        out.append((b" ".join(kept).decode("utf-8"), len(words), len(words) - len(kept)))
    return pd.DataFrame(out, columns=KEPT.names, index=texts.index)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for each row of ``docs``.

    ``text`` holds the kept words, joined by one space. Null texts have no words.
    Rows with one id do not count as smaller than each other, so texts that
    repeat under one id stay. Rows without id keep all words and remove none.
    Texts below ``WINDOW`` words have no window. Extra columns are ignored.
    """
    ranges = (
        repeated_ranges(docs)
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("start", "length")).alias("ranges"))
        .select(F.col("doc_id").alias("in_id"), F.col("row_key").alias("in_key"), "ranges")
    )
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    kept: Column = without_ranges("text", F.col("ranges")["start"], F.col("ranges")["length"])
    return (
        texts.join(ranges, (texts["doc_id"] == ranges["in_id"]) & (texts["row_key"] == ranges["in_key"]), "left")
        .select("doc_id", kept.alias("kept"))
        .select("doc_id", *[F.col("kept")[n].alias(n) for n in KEPT.names])
    )


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
