"""Suffix-array dedup: repeated runs of bytes found with suffix arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier: in a
document of smaller id, or before in the same one. What to sort together is
found by anchors: of a window's ``GRAM``-byte pieces the one of least hash. Equal
windows have equal anchors. Neighbouring windows of one anchor form a segment.

1. Anchors that occur once drop out, and with them most text. Equal segments of
   an anchor become one, at the earliest place; at its other places all its windows
   start earlier elsewhere.
2. Where an anchor has several segments, or is twice in one, these are trimmed to
   the windows whose hash is there again and put together to one string, without
   windows that are earlier in their own piece and runs that are there earlier, and the
   suffixes of all strings of a shard are sorted (``lyndon_groups``). Neighbours
   that agree in ``WINDOW`` bytes are one window; all but its earliest place go.
   The windows of any other segment are all different, so there is nothing to sort.
3. An anchor of more than ``HOT_BYTES`` is trimmed before by an aggregation that Spark
   combines before it shuffles, and cut by the windows' hashes into parts of
   ``PART_WINDOWS`` at most, so no string grows with a hot passage.

Texts are hashed twice, for the anchors' counts and for the segments of those that
are left, as both passes are cheaper than a table of all segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from bindery.llm.lyndon_groups import heads, ranges, suffix_arrays
from bindery.llm.rows import row_key, same_key, small_batches, written
from bindery.llm.suffix_automata import BASE, INVERSE, mixed, sliding_least

WINDOW, GRAM = 100, 24
LONGEST, PORTION, PLACE_BITS = 1000, 1 << 17, 20
SHARD_BYTES, HOT_BYTES, PART_WINDOWS, OUT_ROWS = 1_500_000, 8_000, 4_000, 5_000
VALUES = np.random.default_rng(13).integers(0, 2**64, 256, dtype=np.uint64)
DOC = ["no_id", "doc_id", "row_key"]
DOC_TYPE = "no_id boolean, doc_id long, row_key long"


held_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers and maybe more; one table per base is held, not one per size."""
    if len(held_powers.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        held_powers[base] = np.cumprod(out, out=out)
    return held_powers[base]


class Hashes:
    """Hashes of any runs of bytes, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        most = 1 << len(data).bit_length()
        self.back = powers(INVERSE, most)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(BASE, most)[: len(data)], out=self.sums[1:])

    def run(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        part = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mixed(part + np.asarray(length, np.uint64) * np.uint64(0xA0761D6478BD642F))

    def every(self, length: int) -> np.ndarray:
        """Of all runs of one length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


def all_windows(data: np.ndarray) -> np.ndarray:
    """The hashes of all windows; a run's hash does not depend on its place, so portions of the bytes give them."""
    n = len(data) - WINDOW + 1
    parts = [Hashes(data[i : min(i + PORTION, n) + WINDOW - 1]).every(WINDOW) for i in range(0, n, PORTION)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, anchor, segment, whether the anchor is there twice), by portions.

    Text i is ``data[offsets[i]:offsets[i + 1]]``; windows stay inside a text.
    """
    for begin in range(int(offsets[0]), int(offsets[-1]) - WINDOW + 1, PORTION):
        part = data[begin : min(begin + PORTION + WINDOW - 1, int(offsets[-1]))]
        hashes = Hashes(part)
        pieces = hashes.every(GRAM)
        keyed = (pieces >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(pieces), dtype=np.uint64)
        place = (sliding_least(keyed, WINDOW - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        crossed = offsets[(offsets > begin) & (offsets < begin + len(part))] - begin
        text = np.bincount(crossed, minlength=len(part)).cumsum() + np.searchsorted(offsets, begin, side="right") - 1
        inside = np.flatnonzero(text[: len(place)] == text[WINDOW - 1 :])
        if not len(inside):
            continue
        place, text = place[inside], text[inside]
        anchor = pieces[place]
        new = np.zeros(len(inside), bool)
        new[heads(anchor, text)] = True
        at = np.arange(len(inside))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0
        cut = np.flatnonzero(new)
        n, first = np.diff(cut, append=len(inside)), inside[cut]
        twice = place[cut] != place[cut + n - 1]
        yield text[cut], first + begin - offsets[text[cut]], n, anchor[cut], hashes.run(first, n + WINDOW - 1), twice


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts and where each starts and the last ends; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets


def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, anchor, _, twice in segments(*text_bytes(batch.column("text"))):
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(1 + twice)], names=["anchor", "times"])


def list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, first, n, anchor, segment, twice in segments(*text_bytes(batch.column("text"))):
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(rows) for c in DOC],
                    pa.array(anchor.view(np.int64)),
                    pa.array(segment.view(np.int64)),
                    pa.array(first),
                    pa.array(n.astype(np.int32)),
                    pa.array(twice),
                ],
                names=[*DOC, "anchor", "segment", "first", "n", "twice"],
            )


PIECE = f"anchor long, segment long, {DOC_TYPE}, first long, hot boolean, piece binary"


def cut_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each asked segment of a text."""
    out, last = [], None
    columns = ["anchor", "segment", *DOC, "first", "hot", "piece"]
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = (bool(row.no_id), row.doc_id, row.row_key)
            if own == last:  # the same document in several rows
                continue
            last, text = own, row.text.encode("utf-8")
            for anchor, segment, first, n, hot in zip(row.anchors, row.segments, row.firsts, row.counts, row.hots):
                out.append((anchor, segment, *own, first, hot, text[first : first + n + WINDOW - 1]))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, row_key, first, i, window) of each window of each piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            some = batch.slice(start, OUT_ROWS)
            pieces = some.column("piece").to_pylist()
            windows = [Hashes(np.frombuffer(p, np.uint8)).every(WINDOW) for p in pieces]
            sizes = np.array([len(w) for w in windows])
            rows = pa.array(np.repeat(np.arange(len(pieces)), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("anchor").take(rows),
                    some.column("segment").take(rows),
                    pa.array(ranges(np.zeros(len(sizes), np.int64), sizes).astype(np.int32)),
                    pa.array(np.concatenate(windows).view(np.int64)),
                ],
                names=["anchor", "segment", "i", "window"],
            )


def agree(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the ``WINDOW`` bytes from each of ``a`` equal those from ``b``."""
    width = 8
    words = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width):
        words |= data[k : len(data) - width + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in [*range(0, WINDOW - width, width), WINDOW - width]:
        differs = words[a[left] + k] != words[b[left] + k]
        same[left[differs]] = False
        left = left[~differs]
    return same


GONE = f"{DOC_TYPE}, start long, length long"


def sort_shard(pieces: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows of each piece that start earlier in another piece or place."""
    pieces = pieces.drop_duplicates(["anchor", "part", *DOC, "first", "piece"]).sort_values(["anchor", "part"])
    data = np.frombuffer(b"".join(pieces["piece"]), np.uint8)
    sizes = pieces["piece"].map(len).to_numpy(np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    string = np.zeros(len(sizes), np.int64)
    string[heads(pieces["anchor"].to_numpy(), pieces["part"].to_numpy())[1:]] = 1
    string = np.cumsum(string)

    def of_pieces(piece: np.ndarray, start: np.ndarray, length: np.ndarray) -> pd.DataFrame:
        return pieces.iloc[piece][DOC].reset_index(drop=True).assign(start=start, length=length)

    # Windows that are earlier in their own piece go at once: a text that repeats a word needs one of its periods.
    documents = pieces.groupby(DOC, sort=True, dropna=False).ngroup().to_numpy(np.int64)
    firsts = pieces["first"].to_numpy(np.int64) - begin
    window = np.flatnonzero(np.arange(len(data)) <= (begin + sizes - WINDOW)[owner])
    key = mixed(all_windows(data)[window] ^ mixed(string[owner[window]].astype(np.uint64)))
    copies, held = [], memoryview(data)
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (owner[window[a]] == owner[window[b]])
    if same.any():
        a, b = a[same], b[same]
        inner = np.sort(b[agree(data, window[a], window[b])])
        gone = window[inner]
        at = heads(gone - np.arange(len(gone)), owner[gone]) if len(gone) else gone
        copies.append(of_pieces(owner[gone[at]], firsts[owner[gone[at]]] + gone[at], np.diff(at, append=len(gone)) + WINDOW - 1))
        stay = np.ones(len(window), bool)
        stay[inner] = False
        window, key = window[stay], key[stay]
    del order, a, b, same

    # Trim to the windows whose hash is in the string again. Of equal runs of these only the earliest
    # is sorted, as every window of the others starts earlier in it; then fewer windows are there again.
    while True:
        order = np.argsort(key)
        equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        again = np.zeros(len(window), bool)
        again[order[equal]] = again[order[equal + 1]] = True
        window, key = window[again], key[again]
        del order, equal, again
        at = heads(window - np.arange(len(window)), owner[window]) if len(window) else window
        start, runs = window[at], np.diff(at, append=len(window))
        piece = owner[start]
        by_place = np.lexsort((firsts[piece] + start, documents[piece]))
        later, seen = np.zeros(len(at), bool), set()
        for i, s, b, n in zip(by_place.tolist(), string[piece[by_place]].tolist(), start[by_place].tolist(), runs[by_place].tolist()):
            run = (s, bytes(held[b : b + n + WINDOW - 1]))
            later[i] = run in seen
            seen.add(run)
        del seen
        if not later.any():
            break
        copies.append(of_pieces(piece[later], (firsts[piece] + start)[later], runs[later] + WINDOW - 1))
        stay = np.repeat(~later, runs)
        window, key = window[stay], key[stay]
    if not len(window):
        return pd.concat(copies, ignore_index=True) if copies else of_pieces(window, window, window)
    string = string[piece]
    del key
    sizes, first = runs + WINDOW - 1, firsts[piece] + start
    data = data[ranges(start, sizes)]
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sorted_ = suffix_arrays(data, np.append(begin[heads(string)], len(data)))

    # Windows in order, and the place of each in the order of documents.
    sorted_ = sorted_[sorted_ <= (begin + sizes - WINDOW)[owner[sorted_]]]
    run = owner[sorted_]
    place = ((documents[piece] << 33) + first - begin)[run] + sorted_
    new = np.ones(len(sorted_), bool)
    new[1:] = (string[run[1:]] != string[run[:-1]]) | ~agree(data, sorted_[1:], sorted_[:-1])
    at = np.flatnonzero(new)
    earliest = np.repeat(np.minimum.reduceat(place, at), np.diff(at, append=len(new)))
    gone = np.sort(sorted_[place > earliest])

    at = heads(gone - np.arange(len(gone)), owner[gone]) if len(gone) else gone
    rows = owner[gone[at]]
    copies.append(of_pieces(piece[rows], first[rows] + gone[at] - begin[rows], np.diff(at, append=len(gone)) + WINDOW - 1))
    return pd.concat(copies, ignore_index=True)


def trimmed(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hot anchors' pieces cut to the windows that repeat: (anchor, part, place, piece) once each, and what goes."""
    windows = written(hot.select("anchor", "segment", "piece").mapInArrow(list_windows, "anchor long, segment long, i int, window long"), "windows")
    common = windows.groupBy("anchor", "window").count().filter("count > 1").drop("count")
    parts = common.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / PART_WINDOWS).alias("parts"))
    common = common.join(parts, "anchor").select("anchor", "window", F.pmod("window", "parts").cast("long").alias("part"))
    order = Window.partitionBy("anchor", "segment", "part").orderBy("i")
    spans = (
        windows.join(common, ["anchor", "window"])
        .withColumn("run", F.col("i") - F.row_number().over(order))
        .groupBy("anchor", "segment", "part", "run")
        .agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
        .join(hot, ["anchor", "segment"])
        .withColumn("at", F.struct(*DOC, (F.col("first") + F.col("i")).alias("first")))
        .select("anchor", "part", "at", F.expr(f"substring(piece, i + 1, cast(n as int) + {WINDOW - 1})").alias("piece"))
    )
    spans = written(spans, "spans")
    once = written(spans.groupBy("anchor", "part", "piece").agg(F.min("at").alias("place")), "distinct-spans")
    others = spans.join(once, ["anchor", "part", "piece"]).filter("at <> place")
    return once, others.select("at.no_id", "at.doc_id", "at.row_key", F.col("at.first").alias("start"), F.length("piece").cast("long").alias("length"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(no_id, doc_id, row_key, start, length) in bytes, 0-based, of what goes; ranges may overlap."""
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        row_key().alias("row_key"),
        "text",
    ).filter(F.col("text").isNotNull())
    anchors = texts.select("text").mapInArrow(list_anchors, "anchor long, times long")
    shared = anchors.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor")
    listed = texts.mapInArrow(list_segments, f"{DOC_TYPE}, anchor long, segment long, first long, n int, twice boolean")
    found = written(listed.join(shared, "anchor", "left_semi"), "segments")

    place = F.struct(*DOC, "first")
    owned = written(
        found.withColumn("place", place).groupBy("anchor", "segment").agg(F.min("place").alias("place"), F.min("n").alias("n"), F.max("twice").alias("twice")),
        "owned",
    )
    whole = (
        found.withColumn("at", place)
        .join(owned.select("anchor", "segment", "place"), ["anchor", "segment"])
        .filter("at <> place")
        .select(*DOC, F.col("first").alias("start"), (F.col("n") + F.lit(WINDOW - 1)).cast("long").alias("length"))
    )

    size = (F.col("n") + F.lit(WINDOW - 1)).cast("long")
    sizes = (
        owned.groupBy("anchor")
        .agg(F.sum(size).alias("bytes"), (F.count(F.lit(1)) > 1).alias("several"), F.max("twice").alias("again"))
        .filter("several or again")
        .select("anchor", "bytes")
    )
    asked = (
        owned.join(sizes, "anchor")
        .groupBy(*[F.col("place")[c].alias(c) for c in DOC])
        .agg(F.collect_list(F.struct("anchor", "segment", F.col("place")["first"].alias("first"), "n", (F.col("bytes") > HOT_BYTES).alias("hot"))).alias("asked"))
    )
    fields = {"anchors": "anchor", "segments": "segment", "firsts": "first", "counts": "n", "hots": "hot"}
    pieces = written(
        texts.join(asked, same_key(texts, asked, *DOC))
        .select(*[texts[c] for c in DOC], "text", *[F.col("asked")[f].alias(name) for name, f in fields.items()])
        .mapInPandas(cut_pieces, PIECE),
        "pieces",
    )
    hot = pieces.filter("hot").dropDuplicates(["anchor", "segment"])
    once, elsewhere = trimmed(hot)
    cold = pieces.filter("not hot")
    total = (cold.agg(F.sum(F.length("piece"))).first()[0] or 0) + (once.agg(F.sum(F.length("piece"))).first()[0] or 0)
    shards = int(total // SHARD_BYTES) + 1
    columns = ["anchor", "part", *DOC, "first", "piece"]
    strings = cold.withColumn("part", F.lit(0).cast("long")).select(*columns).unionByName(once.select("anchor", "part", "place.*", "piece").select(*columns))
    inside = strings.withColumn("shard", F.pmod(F.xxhash64("anchor", "part"), F.lit(shards))).groupBy("shard").applyInPandas(sort_shard, GONE)
    return whole.unionByName(elsewhere).unionByName(inside)


KEPT = StructType().add("kept", BinaryType()).add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType())


@F.pandas_udf(KEPT)
def without_ranges(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    out = []
    for text, start, length in zip(texts, starts, lengths):
        data = text.encode("utf-8") if text else b""
        n, kept, spans = len(data), data, 0
        if start is not None and len(start):
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, np.asarray(start) + np.asarray(length), -1)
            stays = np.cumsum(change[:-1]) == 0
            spans = int((~stays[1:] & stays[:-1]).sum()) + int(not stays[0])
            kept = np.frombuffer(data, np.uint8)[stays].tobytes()
        out.append((kept, n, n - len(kept), spans))
    return pd.DataFrame(out, columns=KEPT.names, index=texts.index)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for each row of ``docs``; ``kept`` holds the bytes that stay.

    Null and empty texts have no bytes; texts below ``WINDOW`` bytes lose none. Rows
    alike in id and text are one document and get one result. Documents come in
    the order of ids, those without id last; of one id, different texts are ordered
    by a hash of the text. Removed bytes may cut a character in two, so ``kept`` is
    binary. An empty table gives an empty one; extra columns are ignored.
    """
    gone = (
        repeated_ranges(docs)
        .groupBy(*DOC)
        .agg(F.collect_set(F.struct("start", "length")).alias("ranges"))
        .select(*[F.col(c).alias(f"in_{c}") for c in DOC], "ranges")
    )
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    same = (
        (texts["doc_id"].isNull() == gone["in_no_id"])
        & (F.coalesce(texts["doc_id"].cast("long"), F.lit(0)) == gone["in_doc_id"])
        & (texts["row_key"] == gone["in_row_key"])
    )
    kept = without_ranges("text", F.col("ranges")["start"], F.col("ranges")["length"])
    return (
        texts.join(gone, same, "left")
        .select("doc_id", kept.alias("out"))
        .select("doc_id", *[F.col("out")[c].alias(c) for c in KEPT.names])
    )


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
