"""The registered queries: each operator over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindery.functions import paths, text as tx, tokens
from bindery.operators import (
    budget,
    filters,
    ignore,
    minify,
    outline,
    redact,
    sections,
    stats,
    tree,
    upsert,
)
from bindery.options import PRICES_PER_MILLION, PROMPT_TEMPLATES, Options, Source
from bindery.plans import runs
from bindery.session import all_tasks, scratch_path
from bindery.sources import folders, sinks
from bindery.sources.tables import as_files

Query = Callable[[SparkSession, str], DataFrame]

ROOT = "/corpus"
SUFFIXES = [".txt", ".md", ".py", ".js", ".json", ".csv", ".key", ".log"]
EVERY_SUFFIX = ", ".join(SUFFIXES)
NAMES = ("bob lee", "alice")
MODELS = [*PRICES_PER_MILLION, "unknown-model"]
PROMPT = "  Review the files below.\n"
RUN = Options(as_of="2024-06-01 12:00:00")
RULES = ["# logs", "*.log", "!fr/*.log", "archive/", "/de/d1*.txt", "es/**/tokens.txt", "d?3.md", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(
    spark: SparkSession, sf_dir: str, planted: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``documents`` as files; ``planted`` appends a text made from the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    doc_id = F.col("doc_id")
    if planted is not None:
        docs = docs.withColumn("text", F.concat("text", planted(doc_id)))
    ext = F.element_at(F.array(*map(F.lit, SUFFIXES)), (doc_id % 8 + 1).cast("int"))
    leaf = F.when(doc_id % 13 == 0, F.concat(F.lit("d"), doc_id, F.lit("/tokens.txt"))).otherwise(
        F.concat(F.lit("d"), doc_id, ext)
    )
    folder = F.when(doc_id % 11 == 0, "archive/").otherwise("")
    rel_path = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), folder, leaf)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 365).cast("int"))
    return as_files(docs, F.col("source"), rel_path, F.col("text"), day.cast("timestamp"), ROOT)


def _md5(doc_id: Column) -> Column:
    return F.md5(doc_id.cast("string").cast("binary"))


def plant_names(doc_id: Column) -> Column:
    return (
        F.when(doc_id % 3 == 0, "\nAlice wrote to BOB LEE, not alice@example.com")
        .when(doc_id % 3 == 1, "\nbob  lee and Bob Lee")
        .otherwise("")
    )


def plant_keys(doc_id: Column) -> Column:
    md5, kind = _md5(doc_id), doc_id % 5
    sk = F.concat(F.lit("sk-"), md5, F.substring(md5, 1, 16))
    return F.concat(
        F.lit("\n"),
        F.when(kind == 0, F.concat(F.lit("use "), sk, F.lit(" now")))
        .when(kind == 1, F.concat(F.lit("id AKIA"), F.upper(F.substring(md5, 1, 16))))
        .when(kind == 2, F.concat(F.lit("xoxb-"), doc_id, F.lit("-"), doc_id * 7, F.lit("-"), md5))
        .when(kind == 3, F.concat(F.lit("(ghp_"), md5, F.substring(md5, 1, 4), F.lit(")")))
        .otherwise(F.concat(F.lit("API Key: "), sk)),
    )


def plant_passwords(doc_id: Column) -> Column:
    kind = doc_id % 4
    return (
        F.when(kind == 0, F.concat(F.lit("\nPassword: secret"), doc_id, F.lit("xyz")))
        .when(kind == 1, F.lit("\npass = short"))
        .when(kind == 2, F.concat(F.lit('\nPWD="pw'), _md5(doc_id), F.lit('"\ncompass=north-by-west')))
        .otherwise("")
    )


def plant_everything(doc_id: Column) -> Column:
    return F.concat(plant_names(doc_id), plant_keys(doc_id), plant_passwords(doc_id))


def plant_hash_lines(doc_id: Column) -> Column:
    return F.concat(
        F.lit("\n# note "),
        doc_id,
        F.lit("\nx = "),
        doc_id,
        F.lit("  # note\n\n    a    b   \nc = \"#fff\"\ns = \"it's\"  # keep\n  #!/bin/sh  -x\n   \n"),
    )


def plant_slash_lines(doc_id: Column) -> Column:
    return F.concat(
        F.lit('\n// only\nint x = 1;  // note\nu = "http://h'),
        doc_id,
        F.lit('"\n\n\t call(  a,   b )  \n'),
    )


def plant_both_lines(doc_id: Column) -> Column:
    return F.concat(plant_hash_lines(doc_id), plant_slash_lines(doc_id))


def source_ord() -> Column:
    """A run order of the bundles that is not their name order."""
    number = F.coalesce(F.regexp_extract("bundle", r"([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return number * 7 % 20


def prepared_files(spark: SparkSession, sf_dir: str, options: Options = RUN) -> DataFrame:
    """Kept, redacted documents, from one pass over the text."""
    classified = filters.classify(documents(spark, sf_dir), options)
    return filters.kept(runs.materialise(classified, options))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python sources made from ``part``; one in ten does not parse.

    A file of ``part`` is a few MB that one task would read, and parsing each
    row costs far more than reading it: the narrow rows are dealt to all tasks.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    part = part.repartition(all_tasks(spark))
    key, lit = F.col("p_partkey"), F.lit
    inner = F.when(key % 7 == 0, "\n    class Inner:\n        def deep(self, n: int):\n            return n\n")
    source = F.concat(
        lit("import os\n\n\nclass P"), key, lit("(Base"), key % 3, lit(", object):\n    \"\"\"Part "),
        F.col("p_name"), lit("\"\"\"\n    size = "), F.col("p_size"),
        lit("\n\n    def price(self, qty: int) -> float:\n        \"\"\"Price of qty\"\"\"\n        return qty * self.size\n\n"
            "    async def skip(self):\n        pass\n\n    def brand(self):\n        return \""),
        F.col("p_brand"), lit("\"\n"), F.coalesce(inner, lit("")),
        lit("\n\ndef make_"), key, lit("(x, y: str = \"a\", *rest) -> P"), key, lit(":\n    return P"), key,
        lit("()\n\n\nasync def load_"), key, lit("(path):\n    \"\"\"Load it\"\"\"\n    return path\n"),
        F.when(key % 10 == 0, "def broken(:\n").otherwise(""),
    )
    bundle = F.replace("p_brand", lit("#"), lit("_"))
    rel_path = F.concat(lit("src/p"), key, lit(".py"))
    day = lit("2024-01-01").cast("timestamp")
    return as_files(part, bundle, rel_path, source, day, ROOT)


def _hashed(files: DataFrame) -> DataFrame:
    return files.select(
        "bundle",
        "rel_path",
        F.length("text").cast("bigint").alias("chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


# Scans and filters


def scan_select_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return files.filter(filters.wanted_extension(F.col("path"), "txt, .PY,, .md ,json")).select(
        "bundle", "rel_path", "display_path", "ext", "length"
    )


def _filter_by(keep: Callable[[], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).filter(keep()).select("bundle", "rel_path", "length")

    return query


filter_archive = _filter_by(lambda: ~paths.in_archive(F.col("path")))
filter_safe_mode = _filter_by(
    lambda: ~paths.is_sensitive(F.col("path"), RUN.sensitive_patterns)
)
filter_size = _filter_by(lambda: filters.within_size(F.col("length"), 1, 4))
filter_mtime = _filter_by(
    lambda: filters.modified_since(F.col("modificationTime"), "2024-06-01")
)
COMBINED = Options(min_size_kb=1, max_size_kb=8, modified_after="2024-03-01")
filter_combined = _filter_by(lambda: ~filters.outside_criteria(COMBINED))


def with_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document ends in a NUL byte, early enough in the short ones."""
    files = documents(spark, sf_dir, lambda doc_id: F.when(doc_id % 3 == 0, "\x00").otherwise(""))
    return files.withColumn("content", F.encode("text", "UTF-8"))


def filter_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_nul(spark, sf_dir)
    return files.filter(~tx.is_binary(F.col("content"))).select("bundle", "rel_path", "length")


def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(extensions=EVERY_SUFFIX, min_size_kb=0.5, modified_after="2024-02-01")
    files = with_nul(spark, sf_dir)
    files = files.withColumn("ignored", ignore.ignored_by(F.col("rel_path"), RULES))
    return filters.classify(files, options)


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.skip_counts(classified_files(spark, sf_dir))


def skip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.first_skips(classified_files(spark, sf_dir), 5)


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return files.select(
        "bundle", "rel_path", ignore.ignored_by(F.col("rel_path"), RULES).alias("ignored")
    )


def ignore_rules_by_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bundle has rules of its own: its number decides folder and exception."""
    files = documents(spark, sf_dir).select("bundle", "rel_path")
    number = F.regexp_extract("bundle", r"([0-9]+)$", 1).cast("int")
    lines = F.array(
        F.lit("*.log"),
        F.when(number % 2 == 0, "es/").otherwise("/fr"),
        F.concat(F.lit("!**/d*"), (number % 10).cast("string"), F.lit(".*")),
        F.lit("de/**/tokens.txt"),
    )
    rules = files.select("bundle").distinct().select(
        "bundle", F.posexplode(lines).alias("ord", "pattern")
    )
    return ignore.mark_ignored(files, rules).select("bundle", "rel_path", "ignored")


# Redaction


def redact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(redact.redact_names(documents(spark, sf_dir, plant_names), NAMES))


MEMBERS = tuple(f"member{i:04d}" for i in range(1000))


def plant_members(doc_id: Column) -> Column:
    def member(n: Column) -> Column:
        return F.concat(F.lit("eMber"), F.lpad((n % 1000).cast("string"), 4, "0"))

    return F.concat(F.lit("\nM"), member(doc_id * 7), F.lit(" met m"), member(doc_id), F.lit("m"), member(doc_id * 3 + 1))


def redact_many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand names; ``found`` are the messages of each file."""
    files = documents(spark, sf_dir, plant_members)
    done = redact.redact(files, MEMBERS)
    found = F.transform(F.filter("redactions", lambda r: r["kind"] == "name"), lambda r: r["message"])
    return done.select("bundle", "rel_path", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join(found, "; ").alias("found"))


def redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(redact.redact_emails(documents(spark, sf_dir, plant_names)))


def redact_api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(redact.redact_api_keys(documents(spark, sf_dir, plant_keys)))


def redact_passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(redact.redact_passwords(documents(spark, sf_dir, plant_passwords)))


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(redact.redact_secrets(documents(spark, sf_dir, plant_keys)))


def fully_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact(documents(spark, sf_dir, plant_everything), NAMES)


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(fully_redacted(spark, sf_dir))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redaction_counts(fully_redacted(spark, sf_dir))


def redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redaction_log(fully_redacted(spark, sf_dir)).select("bundle", "line")


# Tokens, cost, budget


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "bundle", "rel_path", tokens.estimate(F.length("text")).alias("tokens")
    )


def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    per_bundle = files.groupBy("bundle").agg(
        F.sum(tokens.estimate(F.length("text"))).alias("tokens")
    )
    return per_bundle.select(
        "bundle", "tokens", F.explode(F.array(*map(F.lit, MODELS))).alias("model")
    ).select(
        "bundle",
        "model",
        "tokens",
        F.round(tokens.cost(F.col("tokens"), F.col("model")), 8).alias("cost_usd"),
    )


def token_budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    per_bundle = files.groupBy("bundle").agg(
        F.sum(tokens.estimate(F.length("text"))).alias("token_count")
    )
    return budget.running_budget(per_bundle.withColumn("source_ord", source_ord()), ["source_ord"], RUN)


# Minify


def _minified(planted: Callable[[Column], Column], lang: str | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = documents(spark, sf_dir, planted)
        name = minify.language(F.col("ext")) if lang is None else F.lit(lang)
        return _hashed(minify.minify(files.withColumn("language", name)))

    return query


minify_hash = _minified(plant_hash_lines, "python")
minify_slash = _minified(plant_slash_lines, "javascript")
minify_mixed = _minified(plant_both_lines, None)


def minify_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir, plant_both_lines)
    before = files.withColumn("language", minify.language(F.col("ext"))).withColumn(
        "old_chars", F.length("text")
    )
    after = minify.minify(before).withColumn("new_chars", F.length("text"))
    return minify.reduction(after, "old_chars", "new_chars", "language")


# Order, tree, sections


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.doc_index(documents(spark, sf_dir))


def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of the run in one order, by bundle and path components."""
    files = documents(spark, sf_dir).select("bundle", "rel_path").withColumn(
        "key", paths.components(F.col("rel_path"))
    )
    numbered = sections.number_rows(files, [], ["bundle", "key"])
    return numbered.select("bundle", "rel_path", F.col("row_no").alias("position"))


def _numbered_tree(files: DataFrame) -> DataFrame:
    lines = tree.tree_lines(files)
    placed = sections.number_rows(lines, ["bundle"], ["key"])
    return placed.select("bundle", F.col("row_no").alias("ordinal"), "line")


def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_tree(documents(spark, sf_dir))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site trees of ``pages``: host is the bundle, URL path the file."""
    url = F.col("url")
    files = table(spark, sf_dir, "pages").select(
        F.regexp_extract(url, r"^https?://([^/]+)/", 1).alias("bundle"),
        F.rtrim(F.regexp_extract(url, r"^https?://[^/]+/([^?#]*)", 1), F.lit("/")).alias("rel_path"),
    )
    return _numbered_tree(files.filter(F.col("rel_path") != "").distinct())


def _sections(output_format: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = Options(as_of=RUN.as_of, output_format=output_format)
        rows = sections.render(prepared_files(spark, sf_dir, options), options)
        return sections.number_sections(rows, output_format)

    return query


sections_standard = _sections("standard")
sections_xml = _sections("xml")
sections_markdown = _sections("markdown")


def prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening sections in each layout, with a prompt."""
    files = documents(spark, sf_dir)
    out = None
    for layout in ("standard", "xml", "markdown"):
        options = Options(
            as_of=RUN.as_of, output_format=layout, prompt=PROMPT, redact=False, outline=True
        )
        heads = sections.section_heads(files, options).select(
            F.lit(layout).alias("layout"), "bundle", "section"
        )
        out = heads if out is None else out.unionByName(heads)
    return out


def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template lookup per language; a language without a template keeps its prompt."""
    named = {"en": "Code Review", "de": "Documentation", "fr": "Refactoring"}
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), "lang")
    run_rows = (
        table(spark, sf_dir, "documents")
        .groupBy("source", "lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat_ws("/", "source", "lang").alias("bundle"),
            F.coalesce(wanted, F.lit("none")).alias("template"),
            F.concat(F.lit("own prompt for "), "n").alias("prompt"),
        )
    )
    templates = spark.createDataFrame(list(PROMPT_TEMPLATES.items()), "name string, body string")
    return sections.with_template(run_rows, templates)


def bundle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.render(prepared_files(spark, sf_dir), RUN)
    return sections.bundle_text(rows).select(
        "bundle",
        "chunk",
        F.length("text").cast("bigint").alias("chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def bundle_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XML text cut at 20,000 characters, to exercise the chunk borders."""
    options = Options(as_of=RUN.as_of, output_format="xml")
    rows = sections.render(prepared_files(spark, sf_dir, options), options)
    return sections.bundle_text(rows, "xml", max_chars=20_000)


def all_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(as_of=RUN.as_of, output_format="markdown")
    rows = sections.render(prepared_files(spark, sf_dir, options), options)
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("bundle")).distinct()
    return sections.all_bundles(rows, "markdown", names.withColumn("source_ord", source_ord()))


# Statistics and reports


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = prepared_files(spark, sf_dir)
    return stats.bundle_stats(files, sections.sizes(files, RUN))


def bundle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(
        F.map_entries("file_types"), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return _stats(spark, sf_dir).withColumn("file_types", F.array_join(entries, " "))


def file_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.file_types(documents(spark, sf_dir))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_totals(_stats(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: filter, redact, render, count and price each source."""
    return runs.Run(filters.classify(documents(spark, sf_dir), RUN), RUN).manifest


SELECTIVE = Options(as_of=RUN.as_of, min_size_kb=24)


def manifest_every_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So high a size bound that some sources keep nothing: they are reported too."""
    return runs.Run(filters.classify(documents(spark, sf_dir), SELECTIVE), SELECTIVE).manifest


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report_lines(_stats(spark, sf_dir), RUN)


# Outlines


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.symbols(code_files(spark, sf_dir))


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.symbol_counts(outline.symbols(code_files(spark, sf_dir)))


def code_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.apply_outline(code_files(spark, sf_dir)).select("bundle", "rel_path", "text")


def outline_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir).withColumn("old_chars", F.length("text"))
    after = outline.apply_outline(files).withColumn("new_chars", F.length("text"))
    return minify.reduction(after, "old_chars", "new_chars", "bundle")


# Keyed merge and files on disk


def _store_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored settings from ``customer``, incoming ones from ``part`` at even keys.

    Stored profiles have a segment and a nation; incoming ones a segment, and
    every third a size, but no nation.
    """

    def settings(frame: DataFrame, name: Column, *pairs: Column) -> DataFrame:
        rows = frame.select(F.concat(F.lit("profile-"), name).alias("name"), F.explode(F.array(*pairs)).alias("s"))
        return rows.select("name", "s.key", "s.value").filter(F.col("value").isNotNull())

    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    old = settings(
        table(spark, sf_dir, "customer"),
        F.col("c_custkey"),
        pair("segment", F.col("c_mktsegment")),
        pair("nation", F.col("c_nationkey")),
    )
    new = settings(
        table(spark, sf_dir, "part"),
        F.col("p_partkey") * 2,
        pair("segment", F.col("p_type")),
        pair("size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))),
    )
    return old, new


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert(*_store_sides(spark, sf_dir), ["name"])


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert(*_store_sides(spark, sf_dir), ["name"], merge=False)


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export the settings and one template per part type, and import them again."""
    profiles, _ = _store_sides(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    templates = part.groupBy(F.col("p_type").alias("name")).agg(
        F.concat(F.lit("Parts:\n- "), F.count(F.lit(1))).alias("body")
    )
    path = scratch_path(spark, "store")
    sinks.export_store(profiles, templates, path, RUN.as_of)
    back, bodies = sinks.import_store(spark, path)
    return back.unionByName(
        bodies.select("name", F.lit("template").alias("key"), F.col("body").alias("value"))
    )


def _typed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Settings of several types: stored ones from ``customer``, incoming ones from ``part`` at every third key."""

    def settings(frame: DataFrame, name: Column, **values: Column) -> DataFrame:
        pairs = [F.struct(F.lit(k).alias("key"), v.cast("variant").alias("value")) for k, v in values.items()]
        return frame.select(F.concat(F.lit("profile-"), name).alias("name"), F.inline(F.array(*pairs)))

    old = settings(
        table(spark, sf_dir, "customer"),
        F.col("c_custkey"),
        segment=F.col("c_mktsegment"),
        nation=F.col("c_nationkey").cast("bigint"),
        safe_mode=F.col("c_custkey") % 2 == 0,
        extensions=F.array(F.lit(".py"), F.col("c_mktsegment")),
        template=F.parse_json(F.lit("null")),
    )
    new = settings(
        table(spark, sf_dir, "part"),
        F.col("p_partkey") * 3,
        segment=F.col("p_type"),
        size=F.col("p_size").cast("bigint"),
        limits=F.array(F.col("p_size").cast("bigint"), F.col("p_partkey").cast("bigint")),
    )
    return old, new


def store_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge settings of several types, export and import them; each value as JSON."""
    path = scratch_path(spark, "store")
    merged = upsert.upsert(*_typed_sides(spark, sf_dir), ["name"])
    sinks.export_store(merged, spark.createDataFrame([], "name string, body string"), path, RUN.as_of)
    back, _ = sinks.import_store(spark, path, typed=True)
    return back.select("name", "key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))


SMALL_FILES = Options(extensions="txt", max_size_kb=4)


def read_files_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write each document as a file with bad bytes and DOS line ends, and read two sources back.

    One source is the whole tree, the other the files of one folder; larger
    files are skipped with their reason.
    """
    docs = table(spark, sf_dir, "documents")
    bad = F.lit(bytearray(b"\xff\xc3 caf\xc3\xa9\xe2\x82\r\nend\r\n"))
    path = scratch_path(spark, "files")
    written = docs.select(
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), bad).alias("content"),
    )
    folders.write_each(written, path, "lang")
    sources = [Source(path, "all"), Source(f"{path}/lang=en", "top", exclude_subfolders=True)]
    files = runs.collect(spark, sources, SMALL_FILES)
    return files.select(
        "bundle",
        F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang"),
        "length",
        F.col("skip_reason").alias("reason"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the bundles in files of 1,000,000 characters and read these back, line by line in order.

    ``line_order`` adds up each line's hash times its place, so lines out of
    order show. A place is the line's own in its file plus the earlier files' lines.
    """
    rows = sections.render(prepared_files(spark, sf_dir), RUN)
    path = scratch_path(spark, "bundles")
    sinks.write_bundles(rows, path, RUN, max_chars=1_000_000)
    name = F.col("_metadata")["file_name"]
    files = spark.read.text(path, wholetext=True).select("bundle_file", name.alias("file"), "value")
    sized = files.select("bundle_file", "file", tx.newlines(F.col("value")).alias("n"))
    placed = sections.number_rows(sized, ["bundle_file"], ["file"], ["n"]).select("bundle_file", "file", "n_before")
    parts = F.split("value", "\n")
    lines = files.select("bundle_file", "file", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("at", "line"))
    digest = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 7), 16, 10).cast("bigint")
    return (
        lines.select("bundle_file", "file", "at", F.length("line").alias("chars"), digest.alias("digest"))
        .join(placed, ["bundle_file", "file"])
        .groupBy("bundle_file")
        .agg(
            F.sum(F.col("chars").cast("bigint") + 1).alias("chars"),
            F.count(F.lit(1)).alias("newlines"),
            F.sum(F.col("digest") * (F.col("n_before") + F.col("at") + 1) % 1_000_003).alias("line_order"),
        )
    )


QUERIES: dict[str, Query] = {
    name: globals()[name]
    for name in (
        "manifest", "manifest_every_source", "scan_select_ext", "filter_archive", "filter_safe_mode", "filter_binary",
        "filter_size", "filter_mtime", "filter_combined", "skip_reasons", "skip_topk",
        "ignore_rules", "ignore_rules_by_bundle", "redact_names", "redact_many_names", "redact_emails",
        "redact_api_keys", "redact_passwords", "redact_secrets", "redact_all",
        "redaction_counts", "redaction_log", "token_estimate", "model_cost",
        "token_budget_running", "minify_hash", "minify_slash", "minify_mixed",
        "minify_reduction", "doc_index", "path_order", "dir_tree", "page_tree",
        "sections_standard", "sections_xml", "sections_markdown", "prompt_prefix",
        "prompt_templates", "bundle_text", "bundle_text_chunks", "all_bundles",
        "bundle_stats", "file_type_histogram", "run_totals", "report_lines",
        "code_symbols", "symbol_counts", "code_outline", "outline_reduction", "upsert_merge",
        "upsert_replace", "store_roundtrip", "store_typed", "read_files_decode", "sink_roundtrip",
    )
}
