"""A run: collect, prepare, render, count, report, write."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindery.functions import paths, text as tx, tokens
from bindery.operators import budget, filters, ignore, minify, outline, redact, sections, stats
from bindery.operators.ordering import number_rows
from bindery.options import Options, Source
from bindery.session import scratch_path
from bindery.sources import folders, sinks


def collect(spark: SparkSession, sources: Sequence[Source], options: Options) -> DataFrame:
    """Classified files of the folders, with decoded text for the kept ones.

    Path, size and date tests run on the listing. Contents are not read for
    files those tests name first, and only to 1,024 bytes where just the
    binary test can still change the reason. A folder that could not be listed
    stays as a skipped row.
    """
    listing = folders.list_files(spark, sources)
    files = listing.filter(
        filters.wanted_extension(F.col("path"), options.extensions) | F.col("list_error").isNotNull()
    )
    if options.respect_ignore:
        files = ignore.mark_ignored(files, folders.ignore_rules(listing))
    want = (
        F.when(F.col("list_error").isNotNull(), 0)
        .when(filters.early_reason(options, files.columns).isNotNull(), 0)
        .when(
            filters.late_reason(options).isNotNull(),
            folders.HEAD_ONLY if options.detect_binary else 0,
        )
        .otherwise(folders.WHOLE)
    )
    read = folders.read_contents(files.withColumn("want", want))
    classified = filters.classify(read, options)
    keep = F.col("skip_reason").isNull()
    return classified.withColumn(
        "text", F.when(keep, tx.decode(F.col("content")))
    ).withColumn(
        "display_path", paths.display_path(F.col("top"), F.col("root"), F.col("path"))
    ).drop("content")


def prepare(files: DataFrame, options: Options) -> DataFrame:
    """Outline, then redact, then minify, as switched on."""
    if options.outline:
        files = outline.apply_outline(files)
    if options.redact:
        files = redact.redact(files, options.names)
    if options.minify:
        files = files.withColumn("language", minify.language(F.col("ext")))
        files = minify.minify(files).drop("language")
    return files


# How a source ended.
WRITTEN = "written"
EMPTY = "no matching files"
FAILED = "folder could not be listed"


def sources_of(classified: DataFrame) -> DataFrame:
    """(bundle, source_ord) of every source that has a file at all; in name order without a list."""
    if "source_ord" in classified.columns:
        return classified.select("bundle", "source_ord").distinct()
    names = classified.select("bundle").distinct()
    return number_rows(names, [], ["bundle"]).select("bundle", (F.col("row_no") - 1).cast("int").alias("source_ord"))


def manifest(
    run_stats: DataFrame,
    options: Options,
    prepared: DataFrame,
    classified: DataFrame | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """One row per source: files, tokens, cost, redaction messages, skips, read errors, status.

    ``sources`` (bundle, source_ord) lists those to report; one of which nothing
    was kept has its row too.
    """
    report = run_stats.select(
        "bundle",
        "total_files",
        "character_count",
        "token_count",
        F.round(tokens.cost(F.col("token_count"), F.lit(options.model)), 8).alias("cost_usd"),
    )
    counts = ["total_files", "character_count", "token_count", "cost_usd"]
    if sources is not None:
        report = sources.select("bundle").join(report, "bundle", "left")
    if "redactions" in prepared.columns:
        found = prepared.groupBy("bundle").agg(
            F.sum(F.size("redactions")).cast("bigint").alias("redaction_messages")
        )
        report = report.join(found, "bundle", "left")
        counts.append("redaction_messages")
    if classified is not None:
        reason = F.col("skip_reason")
        errors = reason.isin(filters.UNREADABLE, filters.UNLISTED)
        if "read_error" in classified.columns:
            errors = errors | (reason.isNull() & F.col("read_error").isNotNull())
        skips = classified.groupBy("bundle").agg(
            F.count("skip_reason").alias("skipped_files"),
            F.count_if(errors).alias("read_errors"),
            F.bool_or(F.coalesce(reason == filters.UNLISTED, F.lit(False))).alias("_unlisted"),
        )
        status = (
            F.when(F.col("total_files") > 0, WRITTEN)
            .when(F.col("_unlisted"), FAILED)
            .otherwise(EMPTY)
        )
        report = report.join(skips, "bundle", "left").withColumn("status", status).drop("_unlisted")
        counts += ["skipped_files", "read_errors"]
    return report.fillna(0, counts)


def report_lines(run_stats: DataFrame, options: Options) -> DataFrame:
    """The printed line of each bundle, with thousands marks and four decimals."""
    cost = tokens.cost(F.col("token_count"), F.lit(options.model))
    return run_stats.select(
        "bundle",
        F.concat(
            F.lit("Tokens: "),
            F.format_number("token_count", 0),
            F.lit(" | Estimated cost: $"),
            F.replace(F.format_number(cost, 4), F.lit(","), F.lit("")),
            F.lit(f" ({options.model})"),
        ).alias("line"),
    )


def materialise(classified: DataFrame, options: Options) -> DataFrame:
    """Run the tests and text stages once, into a table that all else reads.

    Skipped files stay in the table without their text. Steps that order,
    count or draw then scan only the narrow columns, not the text again.
    """
    spark = classified.sparkSession
    table = scratch_path(spark, "prepared")
    is_kept = F.col("skip_reason").isNull()
    prepared = prepare(classified.withColumn("text", F.when(is_kept, F.col("text"))), options)
    sections.measure(prepared, options).write.parquet(table)
    return spark.read.parquet(table)


class Run:
    """The results of one run, each planned when first asked for."""

    def __init__(
        self,
        classified: DataFrame,
        options: Options,
        prompts: DataFrame | None = None,
        sources: DataFrame | None = None,
    ) -> None:
        """``sources`` (bundle, source_ord) is the run's list, as ``folders.source_table`` gives it."""
        self.options = options
        self.prompts = prompts
        self.classified = materialise(classified, options)
        self._sources = sources
        self.prepared = filters.kept(self.classified)

    @cached_property
    def sources(self) -> DataFrame:
        found = sources_of(self.classified) if self._sources is None else self._sources
        return found.select("bundle", "source_ord")

    @cached_property
    def sections(self) -> DataFrame:
        return sections.render(self.prepared, self.options, self.prompts)

    @cached_property
    def stats(self) -> DataFrame:
        sized = sections.sizes(self.prepared, self.options, self.prompts)
        return stats.bundle_stats(self.prepared, sized, self.options.output_format)

    @cached_property
    def manifest(self) -> DataFrame:
        return manifest(self.stats, self.options, self.prepared, self.classified, self.sources)

    @cached_property
    def budget(self) -> DataFrame:
        every = self.sources.join(self.stats.select("bundle", "token_count"), "bundle", "left")
        return budget.running_budget(every.fillna(0, ["token_count"]), ["source_ord"], self.options)

    @cached_property
    def all_bundles(self) -> DataFrame:
        """One context of all bundles, in the order of the sources."""
        return sections.all_bundles(self.sections, self.options.output_format, self.sources)

    @cached_property
    def totals(self) -> DataFrame:
        return stats.run_totals(self.stats, self.options.model)

    @cached_property
    def redactions(self) -> DataFrame:
        return redact.redaction_log(self.prepared)

    @cached_property
    def skips(self) -> DataFrame:
        return filters.skip_counts(self.classified)

    @classmethod
    def over(
        cls, spark: SparkSession, sources: Sequence[Source], options: Options, prompts: DataFrame | None = None
    ) -> Run:
        """A run over folders: every one of ``sources`` is reported, also one without a file."""
        return cls(collect(spark, sources, options), options, prompts, folders.source_table(spark, sources))

    def write(self, path: str) -> None:
        """Bundles below ``bundles`` and the run report below ``report``."""
        sinks.write_bundles(self.sections, f"{path}/bundles", self.options)
        sinks.write_report(self.manifest, f"{path}/report")
