"""Benchmark decontamination by winnowing, in Spark expressions only.

A text is a sequence of words. Of every ``window`` consecutive words the least
hash among its ``gram``-word pieces is kept (Schleimer, Wilkerson, Aiken 2003).
What is kept depends on the window's words alone, so a window that occurs in
both a document and a benchmark item leaves the same fingerprint in both: no
shared span of ``window`` words or more is missed. Neighbouring windows mostly
keep the same piece and are stored as one run. Runs whose fingerprint a
benchmark item has too are extended: each of their windows is compared word for
word with the item's. Items shorter than a window are one window of their own
length, with fingerprints of that length on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.rows import ascii_lower, row_key, same_key, written

WINDOW, GRAM = 13, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also when a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column | str) -> Column:
    """Lower-cased (A-Z) words; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def places(n: Column) -> Column:
    """1 to ``n``; empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def window_minima(hashes: Column, length: int, gram: int) -> Column:
    """For each window of ``length`` words the least hash of its pieces."""
    gram = min(gram, length)
    per_window = length - gram + 1

    def minima(pieces: Column) -> Column:
        if per_window == 1:
            return pieces
        return F.transform(
            places(F.size(pieces) - (per_window - 1)), lambda s: F.array_min(F.slice(pieces, s, per_window))
        )

    pieces = F.transform(places(F.size(hashes) - (gram - 1)), lambda s: F.xxhash64(F.slice(hashes, s, gram)))
    return let(pieces, minima)


def runs(minima: Column, length: int) -> Column:
    """(fingerprint, first window, last window, length) of each run of windows that keep one piece."""

    def changes(m: Column) -> Column:
        return F.filter(places(F.size(m)), lambda s: ~F.get(m, s - 2).eqNullSafe(F.get(m, s - 1)))

    def as_runs(m: Column) -> Column:
        return let(
            changes(m),
            lambda starts: F.transform(
                starts,
                lambda s, i: F.struct(
                    F.xxhash64(F.lit(length), F.get(m, s - 1)).alias("print"),
                    s.alias("first"),
                    F.coalesce(F.get(starts, i + 1) - 1, F.size(m)).alias("last"),
                    F.lit(length).alias("length"),
                ),
            ),
        )

    return let(minima, as_runs)


def fingerprints(words: Column, lengths: list[int], gram: int) -> Column:
    """Runs for every window length."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.concat(*[runs(window_minima(hashes, n, gram), n) for n in lengths]),
    )


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, length, words, window id, fingerprint) of every window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words")).filter(
        F.size("words") > 0
    )
    length = F.least(F.size("words"), F.lit(window))
    spread = items.select(
        "item", "words", length.alias("length"), F.explode(places(F.size("words") - length + 1)).alias("s")
    ).select("item", "length", F.slice("words", F.col("s"), F.col("length")).alias("words"))
    by_length = F.coalesce(
        *[
            F.when(
                F.col("length") == n,
                F.xxhash64(F.lit(n), F.get(window_minima(F.transform("words", lambda w: F.xxhash64(w)), n, gram), F.lit(0))),
            )
            for n in range(1, window + 1)
        ]
    )
    text = F.array_join("words", " ")
    return spread.select("item", "length", text.alias("window"), F.md5(text).alias("window_id"), by_length.alias("print"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Where benchmark windows occur in documents.

    One row per row of ``docs``: doc_id, row_key, n_words, ``hits`` (sorted
    (start, length) in words, 1-based) and ``items`` (sorted ids as strings).
    Null and empty texts have no words and no hits; an item without words hits
    nothing; an item without id hits words but is not listed. Repeated rows get
    the same result each. Extra columns are ignored. Neither side need be small:
    every join is on a fingerprint, window or document, and Spark broadcasts a
    side only if its own size check allows.
    """
    windows = written(item_windows(benchmark, window, gram), "item-windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most `window` numbers
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    # The text is split once; the runs are a narrow table that the joins below read.
    printed = written(
        texts.select("doc_id", "row_key", words_of("text").alias("words")).select(
            "doc_id",
            "row_key",
            F.size("words").cast("long").alias("n_words"),
            (
                fingerprints(F.col("words"), lengths, gram)
                if lengths
                else F.array().cast("array<struct<print:bigint,first:int,last:int,length:int>>")
            ).alias("runs"),
        ),
        "fingerprints",
    )
    shared = (
        printed.select("doc_id", "row_key", F.inline("runs"))
        .join(windows.select("print").distinct(), "print")
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("first", "last", "length")).alias("runs"))
        .withColumnsRenamed({"doc_id": "of_id", "row_key": "of_key"})
    )
    near = texts.join(
        shared, texts["doc_id"].eqNullSafe(shared["of_id"]) & (texts["row_key"] == shared["of_key"])
    ).select("doc_id", "row_key", words_of("text").alias("words"), "runs")
    starts = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda s: F.struct(s.alias("start"), r["length"].alias("length"))),
        )
    )
    candidates = near.select("doc_id", "row_key", "words", F.inline(starts)).select(
        "doc_id",
        "row_key",
        "start",
        "length",
        F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("window"),
    )
    found = written(
        candidates.join(windows.select("window", "length", "window_id").distinct(), ["window", "length"]).select(
            "doc_id", "row_key", "start", "length", "window_id"
        ),
        "hits",
    )
    hits = found.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits")
    )
    items = (
        found.select("doc_id", "row_key", "window_id")
        .distinct()
        .join(windows.filter(F.col("item").isNotNull()).select("window_id", "item").distinct(), "window_id")
        .groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    base = printed.select("doc_id", "row_key", "n_words")
    out = base.join(hits, same_key(base, hits, "doc_id", "row_key"), "left").select(
        base["doc_id"], base["row_key"], "n_words", "hits"
    )
    return out.join(items, same_key(out, items, "doc_id", "row_key"), "left").select(
        out["doc_id"],
        out["row_key"],
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Words inside any of the sorted (start, length) spans, each counted once."""

    def step(acc: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"] - 1
        gain = F.greatest(end - F.greatest(acc["reach"], hit["start"] - 1), F.lit(0))
        return F.struct((acc["n"] + gain).alias("n"), F.greatest(acc["reach"], end).alias("reach"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(hits, none, step, lambda acc: acc["n"])


def judged(hits: DataFrame, share: int = 20) -> DataFrame:
    """``hits`` with n_hit and contaminated: at least one word in ``share`` is hit."""
    n_hit = covered(F.col("hits"))
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts, the hash of the items found, and the verdict, per document."""
    return judged(benchmark_hits(docs, benchmark)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    bad = judged(benchmark_hits(docs, benchmark)).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct()
    match = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (row_key() == bad["bad_key"])
    return docs.join(bad, match, "left_anti")
