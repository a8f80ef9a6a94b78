"""Folders of files as a table, listed and read by the executors.

Spark's own file sources leave out names that start with ``_`` or ``.``
(``__init__.py`` for one) and list on the driver, so folders are listed here:
one job per level, each task listing some folders, and contents are read only
for files that earlier tests have not already dropped. Nothing is lost without a
row: a folder that cannot be listed is a row with ``list_error``, a file that
cannot be read has ``read_error``. Links to folders are not followed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindery.functions import paths, text as tx
from bindery.operators.ignore import usable_lines
from bindery.options import Source
from bindery.session import all_tasks, durable

IGNORE_FILES = (".gptignore", ".gitignore")
SOURCE = "source_ord int, bundle string, top string, root string, recursive boolean, include_archive boolean, dir string"
LISTING = f"{SOURCE}, name string, is_dir boolean, length bigint, modificationTime timestamp, list_error string"
LIST_BATCH = 10_000
READ_BATCH_BYTES = 32 << 20
SPLIT_BYTES = 512 << 20
WHOLE, HEAD_ONLY = -1, 1024
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = {ord(c): f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^\x7f"]}
MAX_VALUE_BYTES = 2_000_000_000  # a Spark value ends at 2 GiB: such a file is reported as not readable


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _join(*parts: str) -> str:
    return "/".join(p for p in parts if p)


def _is_link(filesystem: pafs.FileSystem, path: str) -> bool:
    return isinstance(filesystem, pafs.LocalFileSystem) and os.path.islink(path)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each folder; one row with the error for a folder that cannot be listed."""
    opened: dict[str, tuple[pafs.FileSystem, str]] = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            source = row._asdict()
            try:
                filesystem, base = opened.get(row.root) or _filesystem(row.root)
                opened[row.root] = filesystem, base
                entries = filesystem.get_file_info(pafs.FileSelector(_join(base, row.dir)))
            except (OSError, ValueError) as problem:
                none = pd.array([None], dtype="Int64")
                missing = {"name": [""], "is_dir": [False], "length": none, "modificationTime": [pd.NaT]}
                yield pd.DataFrame({**missing, **source, "list_error": [str(problem)]})
                continue
            entries = [
                e for e in entries if e.type != pafs.FileType.Directory or not _is_link(filesystem, e.path)
            ]
            for start in range(0, len(entries), LIST_BATCH):
                part = entries[start : start + LIST_BATCH]
                yield pd.DataFrame(
                    {
                        "name": [e.base_name for e in part],
                        "is_dir": [e.type == pafs.FileType.Directory for e in part],
                        "length": pd.array([e.size for e in part], dtype="Int64"),
                        "modificationTime": [e.mtime for e in part],
                        **source,
                        "list_error": None,
                    }
                )


def folder_of(key: str, value: str | None) -> str:
    """The folder name that Spark's partitioned writers give."""
    return f"{key}={value.translate(ESCAPED) if value else NO_VALUE}"


def _written(path: str, key: str):
    """Write each ``content`` to the folder of its key; one row with the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(path)
        name, n, folders = f"part-{TaskContext.get().partitionId():05d}", 0, {}
        for batch in batches:
            for value, content in zip(batch.column(key).to_pylist(), batch.column("content")):
                if value not in folders:
                    folders[value] = _join(base, folder_of(key, value))
                    filesystem.create_dir(folders[value])
                with filesystem.open_output_stream(f"{folders[value]}/{name}-{n}.txt", compression=None) as f:
                    f.write(content.as_buffer())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return write


def write_each(rows: DataFrame, path: str, key: str) -> int:
    """Write each row's ``content`` as a file of its own in ``<key>=<value>`` below ``path``; returns how many.

    Spark's writers create, move and commit such files one by one, the moves on the
    driver. Here tasks write to the last place at once. Names come from the
    partition and the place in it, so a task tried again writes its files anew and
    leaves none twice: ``rows`` must come in the same order then, as those of a
    table do. ``path`` must be of a kind that ``pyarrow.fs`` opens.
    """
    filesystem, base = _filesystem(path)
    filesystem.create_dir(base)  # also where no task has a row to write
    counts = rows.select(key, "content").mapInArrow(_written(path, key), "files bigint")
    return counts.agg(F.sum("files")).first()[0] or 0


def source_table(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """One row per source: its place in the list, bundle, folder name and root."""
    rows = [
        (i, s.bundle, s.top, s.root.rstrip("/"), not s.exclude_subfolders, s.include_archive, "")
        for i, s in enumerate(sources)
    ]
    return spark.createDataFrame(rows, SOURCE)


def list_files(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Files below the sources: source_ord, bundle, top, root, path, rel_path, ext, length, time.

    A bundle comes from one source, so paths are unique within it. A folder that
    cannot be listed is a row with its own path and ``list_error``.
    """
    if len({s.bundle for s in sources}) < len(sources):
        raise ValueError("two sources name the same bundle")
    frontier = source_table(spark, sources)
    levels: DataFrame | None = None
    while not frontier.isEmpty():
        listed = durable(frontier.repartition(all_tasks(spark)).mapInPandas(_list, LISTING))
        files = listed.filter(~F.col("is_dir"))
        levels = files if levels is None else levels.unionByName(files)
        below = F.concat_ws("/", F.nullif("dir", F.lit("")), "name")
        frontier = listed.filter(F.col("is_dir") & F.col("recursive")).select(
            "source_ord", "bundle", "top", "root", "recursive", "include_archive", below.alias("dir")
        )
    if levels is None:
        levels = spark.createDataFrame([], LISTING)
    rel = F.concat_ws("/", F.nullif("dir", F.lit("")), F.nullif("name", F.lit("")))
    return levels.select(
        "source_ord",
        "bundle",
        "top",
        "root",
        F.concat_ws("/", "root", rel).alias("path"),
        rel.alias("rel_path"),
        paths.suffix(rel).alias("ext"),
        "length",
        "modificationTime",
        "include_archive",
        "list_error",
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fill ``content`` up to ``want`` bytes; an unreadable file gets a message."""
    opened: dict[str, tuple[pafs.FileSystem, str]] = {}
    for batch in batches:
        contents: list[bytes | None] = []
        errors: list[str | None] = []
        start = held = 0
        for row in batch.itertuples(index=False):
            content, error = None, None
            if row.want == WHOLE and row.length > MAX_VALUE_BYTES:
                error = f"{row.length} bytes do not fit a value"
            elif row.want:
                filesystem, base = opened.get(row.root) or _filesystem(row.root)
                opened[row.root] = filesystem, base
                try:
                    with filesystem.open_input_stream(_join(base, row.rel_path), compression=None) as f:
                        content = f.read(None if row.want == WHOLE else int(row.want))
                except OSError as problem:
                    error = str(problem)
            contents.append(content)
            errors.append(error)
            held += len(content or b"")
            if held >= READ_BATCH_BYTES:
                stop = start + len(contents)
                yield batch.iloc[start:stop].assign(content=contents, read_error=errors)
                start, held, contents, errors = stop, 0, [], []
        if contents:
            yield batch.iloc[start:].assign(content=contents, read_error=errors)


def read_contents(listing: DataFrame) -> DataFrame:
    """Add ``content`` and ``read_error``; ``want`` says how many bytes to read.

    The listing, narrow rows, is kept first: the tests on it run once, not once
    for the sum of bytes and again for the read.
    """
    spark = listing.sparkSession
    listing = durable(listing)
    asked = F.when(F.col("want") == WHOLE, F.col("length")).otherwise(F.col("want"))
    total = listing.agg(F.sum(asked)).first()[0] or 0
    tasks = max(all_tasks(spark), -(-total // SPLIT_BYTES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    return (
        listing.repartition(int(tasks))
        .mapInPandas(_read, f"{schema}, content binary, read_error string")
        .drop("want")
    )


def read_files(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Every file with its decoded text; no filter but the folder itself."""
    listing = list_files(spark, sources).filter(F.col("list_error").isNull())
    read = read_contents(listing.withColumn("want", F.lit(WHOLE)))
    return read.withColumn("text", tx.decode(F.col("content"))).withColumn(
        "display_path", paths.display_path(F.col("top"), F.col("root"), F.col("path"))
    )


def ignore_files(listing: DataFrame) -> DataFrame:
    """The roots' ignore files ``(bundle, rel_path, lines, usable)``; one unread or with a bad rule is not usable."""
    found = (
        listing.filter(F.col("rel_path").isin(*IGNORE_FILES) & F.col("list_error").isNull())
        .withColumn("want", F.lit(WHOLE))
        .transform(read_contents)
    )
    lines = F.coalesce(F.split(tx.decode(F.col("content")), "\n"), F.array().cast("array<string>"))
    return found.select("bundle", "rel_path", "read_error", lines.alias("lines")).select(
        "bundle", "rel_path", "lines", (F.col("read_error").isNull() & usable_lines("lines")).alias("usable")
    )


def ignore_rules(listing: DataFrame) -> DataFrame:
    """Rule lines ``(bundle, ord, pattern)`` of each root's first usable ignore file."""
    priority = F.array_position(F.array(*map(F.lit, IGNORE_FILES)), F.col("rel_path"))
    usable = ignore_files(listing).filter("usable")
    chosen = usable.groupBy("bundle").agg(F.min_by("lines", priority).alias("lines"))
    return chosen.select("bundle", F.posexplode("lines").alias("ord", "pattern"))
