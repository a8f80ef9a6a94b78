"""Token counts from flat token files by a separator scan.

A token file is a run of 16-bit ids, documents one after another, each followed
by the end-of-document id; nothing says where a document starts. Files are cut
into blocks of a fixed number of ids. Each block is searched for separators in
one vector comparison, so blocks are independent. A document that spans blocks
is put together by a prefix scan over the block summaries: how many separators
lie before a block, and where the last of them is. The scan has two levels, so
no window holds more than ``SPAN`` blocks or their groups.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from bindery.llm.rows import written
from bindery.session import scratch_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
BLOCK, SPAN = 1 << 20, 1024


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


PLACED = "file string, nth long, doc_id long"


def write_token_files(docs: DataFrame, path: str, ranks: str = RANKS, separator: int = SEPARATOR) -> DataFrame:
    """Write ``part-<n>-<attempt>`` files of ids below ``path``; returns (file, nth, doc_id), what lies where.

    Null texts are empty documents. The task that writes a file also gives out its
    places, so both come from the same rows whatever the splits are. A file has a
    name of its own per attempt: what a lost task left behind has no places and is
    no token file. Tokens are not shuffled. ``path`` must be of a kind that
    ``pyarrow.fs`` opens, and be reachable from the executors.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())  # one vocabulary file
    end = separator.to_bytes(2, "little")
    system, folder = file_system(path)
    system.create_dir(folder)  # also where no task has a row to write

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out, nth = encoding(shared.value), None, 0
        system, folder = file_system(path)
        name = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows and out is None:
                out = system.open_output_stream(f"{folder}/{name}")
            for text in batch.column("text"):
                out.write(np.array(coder.encode_ordinary(text.as_py() or ""), "<u2").tobytes() + end)
            places = pa.array(np.arange(nth, nth + batch.num_rows))
            nth += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * batch.num_rows, pa.string()), places, batch.column("doc_id")], names=["file", "nth", "doc_id"]
            )
        if out is not None:
            out.close()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, PLACED), "token-places")


SCANNED = (
    StructType()
    .add("path", StringType())
    .add("block", LongType())
    .add("first", LongType())
    .add("last", LongType())
    .add("between", ArrayType(IntegerType()))
)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def open_file(path: str) -> pa.NativeFile:
    system, name = file_system(path)
    return system.open_input_file(name)


def scanner(separator: int, block: int):
    """Per block its first and last separator, as places in the file, and the ids between neighbours."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, number in zip(batch["path"], batch["block"]):
                with open_file(path) as file:
                    data = file.read_at(2 * block, 2 * block * number)
                at = np.flatnonzero(np.frombuffer(data, "<u2", len(data) // 2) == separator) + block * number
                ends = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                rows.append((path, number, *ends, (np.diff(at) - 1).astype(np.int32)))
            out = pd.DataFrame(rows, columns=SCANNED.names)
            yield out.astype({"first": "Int64", "last": "Int64"})

    return scan


def count_tokens(
    spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, only: DataFrame | None = None
) -> DataFrame:
    """(path, nth, n_tokens, ended) of every document in the token files below ``path``.

    ``nth`` counts from 0 in each file. Ids after the last separator are a
    document with ``ended`` false; two separators in a row enclose an empty one.
    Files without ids give nothing; an odd last byte is no id. ``block`` does not
    change results. Files must be reachable by their URI from the executors. ``only``
    (file) names the files to scan; without it all ``part-*`` are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.select("path", F.floor(F.col("length") / 2).alias("ids")).filter("ids > 0")
    if only is not None:
        files = files.join(only, F.substring_index("path", "/", -1) == only["file"], "left_semi")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block))).alias("block"))
    tasks = max(1, min(blocks.count(), 100_000))
    scanned = written(blocks.repartition(tasks, "path", "block").mapInPandas(scanner(separator, block), SCANNED), "scanned")

    some = F.when(F.col("first").isNull(), 0).otherwise(F.size("between") + 1).cast("long")
    summary = scanned.select("path", "block", "last", some.alias("n"), F.floor(F.col("block") / SPAN).alias("span"))

    def before(order: str, *by: str) -> Window:
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    spans = summary.groupBy("path", "span").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    spans = spans.select(
        "path",
        "span",
        F.coalesce(F.sum("n").over(before("span", "path")), F.lit(0)).alias("span_n"),
        F.max("last").over(before("span", "path")).alias("span_last"),
    )
    inside = before("block", "path", "span")
    ahead = (
        summary.select(
            "path",
            "block",
            "span",
            F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n_here"),
            F.max("last").over(inside).alias("last_here"),
        )
        .join(spans, ["path", "span"])
        .select(
            "path",
            "block",
            (F.col("span_n") + F.col("n_here")).alias("n_before"),
            F.coalesce("last_here", "span_last", F.lit(-1)).alias("last_before"),
        )
    )
    lengths = F.concat(
        F.array((F.col("first") - F.col("last_before") - 1)), F.transform("between", lambda x: x.cast("long"))
    )
    ended = (
        scanned.filter("first is not null")
        .join(ahead, ["path", "block"])
        .select("path", "n_before", F.posexplode(lengths).alias("i", "n_tokens"))
        .select("path", (F.col("n_before") + F.col("i")).alias("nth"), "n_tokens", F.lit(True).alias("ended"))
    )
    totals = summary.groupBy("path").agg(F.sum("n").alias("nth"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    open_end = (
        files.join(totals, "path")
        .select("path", "nth", (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
        .filter("n_tokens > 0")
    )
    return ended.unionByName(open_end)


def digest(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token files, scan them, and name each count's document.

    Rows with equal or null ids are documents of their own. An empty table gives no
    rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    placed = write_token_files(docs, path)
    counts = count_tokens(spark, path, only=placed.select("file").distinct()).select(
        F.substring_index("path", "/", -1).alias("file"), "nth", "n_tokens", "ended"
    )
    file_no = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("int")
    return placed.join(counts, ["file", "nth"], "full").select("doc_id", file_no.alias("file_no"), "nth", "n_tokens", "ended")
