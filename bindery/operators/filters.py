"""Which files a run keeps, and why the others were skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.functions import paths, text as tx
from bindery.options import Options, parse_extensions
from bindery.session import durable

# The reasons a run reports.
ARCHIVE = "in archive folder"
IGNORED = "matched .gitignore/.gptignore"
BINARY = "binary file"
SENSITIVE = "excluded by Safe Mode"
CRITERIA = "filtered by size/date criteria"
# Reasons of our own: what went wrong on the way to the text.
UNLISTED = "folder could not be listed"
UNREADABLE = "could not be read"


def wanted_extension(path: Column, listed: str) -> Column:
    return paths.suffix(path).isin(parse_extensions(listed))


def within_size(length: Column, min_kb: float | None, max_kb: float | None) -> Column:
    """Inclusive bounds in KB; a lower bound of 0 never drops a file."""
    kb = length / F.lit(1024.0)
    keep = F.lit(True)
    if max_kb is not None:
        keep = keep & (kb <= F.lit(float(max_kb)))
    if min_kb is not None:
        keep = keep & (kb >= F.lit(float(min_kb)))
    return F.coalesce(keep, F.lit(True))


def modified_since(mtime: Column, day: str) -> Column:
    """On or after the date; an unreadable date or time keeps the file."""
    return F.coalesce(mtime >= F.try_to_timestamp(F.lit(day)), F.lit(True))


def outside_criteria(options: Options) -> Column | None:
    """Size and date test, or None when no bound is set."""
    if not (options.max_size_kb or options.min_size_kb or options.modified_after):
        return None
    keep = within_size(F.col("length"), options.min_size_kb, options.max_size_kb)
    if options.modified_after:
        keep = keep & modified_since(F.col("modificationTime"), options.modified_after)
    return ~keep


def early_reason(options: Options, columns: list[str]) -> Column:
    """Archive and ignore rules: known from the path alone.

    ``include_archive`` may also be a column, set by each source.
    """
    reason = F.lit(None).cast("string")
    if "ignored" in columns and options.respect_ignore:
        reason = F.when(F.col("ignored"), IGNORED).otherwise(reason)
    if not options.include_archive:
        archived = paths.in_archive(F.col("path"))
        if "include_archive" in columns:
            archived = archived & ~F.col("include_archive")
        reason = F.when(archived, ARCHIVE).otherwise(reason)
    return reason


def late_reason(options: Options) -> Column:
    """Sensitive names, then size and date."""
    reason = F.lit(None).cast("string")
    criteria = outside_criteria(options)
    if criteria is not None:
        reason = F.when(criteria, CRITERIA).otherwise(reason)
    if options.safe_mode:
        hit = paths.is_sensitive(F.col("path"), options.sensitive_patterns)
        reason = F.when(hit, SENSITIVE).otherwise(reason)
    return reason


def classify(files: DataFrame, options: Options) -> DataFrame:
    """Add ``skip_reason``, null for kept files; the first hit wins.

    Files of other extensions are left out silently; folders that could not be
    listed stay as rows with that reason. ``files`` has ``content`` or ``text``,
    and ``ignored`` when rules were matched. A file that could not be read is
    named so where its bytes were asked for to tell text from binary.
    """
    wanted = wanted_extension(F.col("path"), options.extensions)
    if "list_error" in files.columns:
        wanted = wanted | F.col("list_error").isNotNull()
    listed = files.filter(wanted)
    reason = late_reason(options)
    if options.detect_binary:
        binary = (
            tx.is_binary(F.col("content"))
            if "content" in files.columns
            else tx.text_is_binary(F.col("text"))
        )
        reason = F.when(binary, BINARY).otherwise(reason)
        if "content" in files.columns and "read_error" in files.columns:
            reason = F.when(F.col("read_error").isNotNull(), UNREADABLE).otherwise(reason)
    early = early_reason(options, files.columns)
    if "list_error" in files.columns:
        early = F.when(F.col("list_error").isNotNull(), UNLISTED).otherwise(early)
    return listed.withColumn("skip_reason", F.coalesce(early, reason))


def kept(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("skip_reason").isNull()).drop(
        "skip_reason", "ignored", "include_archive", "list_error"
    )


def skipped(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("skip_reason").isNotNull()).select(
        "bundle", "rel_path", F.col("skip_reason").alias("reason")
    )


def skip_counts(classified: DataFrame) -> DataFrame:
    """Skipped files per bundle and reason."""
    return (
        skipped(classified)
        .groupBy("bundle", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def first_skips(classified: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` lines of a bundle's skip list and how many more there are.

    Skips are listed in path order, but for size and date: these are one line
    with their number, at the end. The rank filter lets Spark keep ``k`` rows per
    bundle before the shuffle. The skipped paths are kept once, so the tests do
    not run again for the count.
    """
    rows = durable(skipped(classified))
    order = Window.partitionBy("bundle").orderBy(paths.components(F.col("rel_path")))
    single = rows.filter(F.col("reason") != CRITERIA)
    top = single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    grouped = F.col("reason") == CRITERIA
    counts = rows.groupBy("bundle").agg(
        F.count_if(~grouped).alias("singles"), F.count_if(grouped).alias("criteria")
    )
    lines = top.select(
        "bundle",
        "rank",
        F.concat(paths.file_name(F.col("rel_path")), F.lit(" ("), F.col("reason"), F.lit(")")).alias("line"),
    ).unionByName(
        counts.filter((F.col("criteria") > 0) & (F.col("singles") < k)).select(
            "bundle",
            (F.col("singles") + 1).cast("int").alias("rank"),
            F.concat("criteria", F.lit(f" file(s) {CRITERIA}")).alias("line"),
        )
    )
    listed = F.col("singles") + (F.col("criteria") > 0).cast("int")
    return lines.join(counts, "bundle").select(
        "bundle",
        F.col("rank").cast("bigint").alias("rank"),
        "line",
        F.greatest(listed - k, F.lit(0)).cast("bigint").alias("more"),
    )
