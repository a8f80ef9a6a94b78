"""Bundles as ordered section rows in three layouts.

A section row is ``(bundle, part, key, section, chars, lines)``. Ordering by
(part, key) within a bundle and ending every section with a newline gives the
bundle's text; the XML text alone has no newline after its last line. ``chars``
and ``lines`` count that newline, so totals need not read the sections. The index of
an XML body is put in where its place is known (``placement``) and not counted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import paths, tokens
from bindery.functions.text import SPACE, newlines, title, xml_escape
from bindery.operators.ordering import number_rows
from bindery.operators.placement import SLOT_CHARS, index_digits, placed
from bindery.operators.tree import tree_lines, tree_sizes
from bindery.options import Options

HEAD, TREE, TREE_END, BODY, TAIL, GAP = range(6)

# Layout strings and fence names by suffix.
RULE = "=" * 80
ENABLED = "ENABLED"
OUTLINE_ENABLED = "ENABLED (signatures only)"
FENCE_BY_SUFFIX = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".sh": "bash", ".sql": "sql", ".json": "json",
    ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown",
    ".html": "html", ".css": "css", ".scss": "scss",
}


def _text(*lines: str | Column) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def metadata(total_files: Column, options: Options) -> Column:
    """Ordered ``(key, value)`` pairs; flags appear only when on."""
    pairs = [
        ("generated_by", F.lit(options.generated_by)),
        ("timestamp", F.date_format(F.lit(options.as_of).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")),
        ("total_files", total_files.cast("string")),
        ("output_format", F.lit(options.output_format)),
    ]
    if options.redact:
        pairs.append(("pii_sanitization", F.lit(ENABLED)))
    if options.outline:
        pairs.append(("skeleton_mode", F.lit(OUTLINE_ENABLED)))
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])


def prompt_prefix(prompt: Column, output_format: str) -> Column:
    """Prompt block before the bundle; nothing for a blank prompt."""
    body = F.regexp_replace(prompt, rf"(?U)\A{SPACE}+|(?<!{SPACE}){SPACE}++\z", "")
    block = {
        "xml": F.concat(F.lit("<!-- System Instructions -->\n"), body, F.lit("\n\n")),
        "markdown": F.concat(F.lit("## System Instructions\n\n"), body, F.lit("\n\n")),
    }.get(
        output_format,
        F.concat(F.lit("SYSTEM INSTRUCTIONS:\n"), body, F.lit(f"\n\n{RULE}\n\n")),
    )
    return F.when(F.length(body) > 0, block).otherwise("")


def _standard_head(meta: Column, options: Options) -> Column:
    labels = ["Generated by ", "Timestamp: ", "Total files: "]
    lines = [F.concat(F.lit(label), meta[i]["value"]) for i, label in enumerate(labels)]
    if options.redact:
        lines.append(F.lit(f"PII Sanitization: {ENABLED}"))
    if options.outline:
        lines.append(F.lit(f"Skeleton Mode: {OUTLINE_ENABLED}"))
    lines += [F.lit(""), F.lit(RULE)]
    if options.show_tree:
        lines += [F.lit(""), F.lit("DIRECTORY STRUCTURE:"), F.lit(RULE)]
    return _text(*lines)


def _xml_head(meta: Column) -> Column:
    entries = F.transform(
        meta,
        lambda m: F.concat(
            F.lit("    <"), m["key"], F.lit(">"), m["value"], F.lit("</"), m["key"], F.lit(">")
        ),
    )
    return _text(
        "<?xml version='1.0' encoding='UTF-8'?>",
        "<context>",
        "  <metadata>",
        F.array_join(entries, "\n"),
        "  </metadata>",
        "  <documents>",
    )


def _markdown_head(meta: Column) -> Column:
    entries = F.transform(
        meta, lambda m: F.concat(F.lit("- **"), title(m["key"]), F.lit("**: "), m["value"])
    )
    return _text("# AI Context", "", "## Metadata", F.array_join(entries, "\n"), "", "## Files")


def _standard_body() -> Column:
    path, text = F.col("display_path"), F.col("text")
    ends_open = (text != "") & ~F.endswith(text, F.lit("\n"))
    return _text(
        "",
        RULE,
        F.concat(F.lit("BEGIN FILE: "), path),
        RULE,
        F.concat(text, F.when(ends_open, "\n").otherwise("")),
        RULE,
        F.concat(F.lit("END FILE: "), path),
        RULE,
    )


_XML_OPEN = "    <document index='"
_XML_TAIL = "  </documents>\n</context>"


def _xml_body() -> Column:
    return _text(
        f"{_XML_OPEN}'>",
        F.concat(F.lit("      <source>"), F.col("display_path"), F.lit("</source>")),
        "      <document_content>",
        xml_escape(F.col("text")),
        "      </document_content>",
        "    </document>",
    )


def with_index(section: Column | str, index: Column) -> Column:
    """An XML body with its document index."""
    return F.overlay(section, index.cast("string"), F.lit(len(_XML_OPEN) + 1), F.lit(0))


def _markdown_body() -> Column:
    path = F.col("display_path")
    fence = tokens.lookup_literal(paths.suffix(path), FENCE_BY_SUFFIX, "")
    return _text(
        "",
        F.concat(F.lit("### File: `"), path, F.lit("`")),
        "",
        F.concat(F.lit("```"), fence),
        F.col("text"),
        "```",
    )


def _chars(section: Column) -> Column:
    return F.length(section).cast("bigint") + 1


def _lines(section: Column) -> Column:
    return newlines(section) + 1


def _rows(
    df: DataFrame,
    part: int,
    section: Column,
    key: Column | None = None,
    chars: Column | None = None,
    lines: Column | None = None,
) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(
        "bundle",
        F.lit(part).alias("part"),
        (empty if key is None else key).alias("key"),
        section.alias("section"),
        (_chars(section) if chars is None else chars).alias("chars"),
        (_lines(section) if lines is None else lines).alias("lines"),
    )


def doc_index(files: DataFrame) -> DataFrame:
    """1-based position of each file of a bundle in path order."""
    keys = files.select("bundle", "rel_path", paths.components(F.col("rel_path")).alias("key"))
    return number_rows(keys, ["bundle"], ["key"]).select(
        "bundle", "rel_path", F.col("row_no").alias("doc_index")
    )


def with_template(runs: DataFrame, templates: DataFrame) -> DataFrame:
    """Replace ``prompt`` by the body of the named template; unknown names change nothing."""
    named = templates.select(F.col("name").alias("template"), "body")
    return runs.join(named, "template", "left").select(
        *[c for c in runs.columns if c != "prompt"], F.coalesce("body", "prompt").alias("prompt")
    )


def section_heads(
    files: DataFrame, options: Options, prompts: DataFrame | None = None
) -> DataFrame:
    """The opening section of each bundle, counting unreadable files too.

    ``prompts`` gives a bundle its own prompt in place of the run's.
    """
    counts = files.groupBy("bundle").agg(F.count(F.lit(1)).alias("total_files"))
    prompt = F.lit(options.prompt)
    if prompts is not None:
        counts = counts.join(prompts.select("bundle", "prompt"), "bundle", "left")
        prompt = F.coalesce("prompt", prompt)
    meta = counts.withColumn("meta", metadata(F.col("total_files"), options))
    head = {"xml": _xml_head, "markdown": _markdown_head}.get(
        options.output_format, lambda m: _standard_head(m, options)
    )(F.col("meta"))
    prefix = prompt_prefix(prompt, options.output_format)
    return _rows(meta, HEAD, F.concat(prefix, head))


def _body(output_format: str) -> Column:
    if output_format == "xml":
        return _xml_body()
    return _markdown_body() if output_format == "markdown" else _standard_body()


def measure(files: DataFrame, options: Options) -> DataFrame:
    """Add ``body_chars`` and ``body_lines`` while the text is at hand."""
    body = _body(options.output_format)
    return files.withColumn("body_chars", _chars(body)).withColumn("body_lines", _lines(body))


def section_bodies(files: DataFrame, options: Options) -> DataFrame:
    """One section per readable file."""
    measured = "body_chars" in files.columns
    return _rows(
        files.filter(F.col("read_error").isNull()),
        BODY,
        _body(options.output_format),
        paths.components(F.col("rel_path")),
        F.col("body_chars") if measured else None,
        F.col("body_lines") if measured else None,
    )


def render(
    files: DataFrame, options: Options, prompts: DataFrame | None = None
) -> DataFrame:
    """All section rows of the bundles of ``files``.

    ``files`` has bundle, rel_path, display_path, read_error and text. The
    filter on readable files is on read_error: one on the text would be pushed
    down and drag a copy of every text stage with it.
    """
    parts = [section_heads(files, options, prompts), section_bodies(files, options)]
    bundles = files.select("bundle").distinct()
    if options.output_format == "xml":
        parts.append(_rows(bundles, TAIL, F.lit(_XML_TAIL)))
    elif options.output_format != "markdown" and options.show_tree:
        lines = tree_lines(files)
        parts.append(_rows(lines, TREE, F.col("line"), F.col("key")))
        parts.append(_rows(bundles, TREE_END, F.lit(RULE)))
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out


def sizes(files: DataFrame, options: Options, prompts: DataFrame | None = None) -> DataFrame:
    """``(bundle, part, chars, lines)`` with the sums of ``render``, for statistics: no tree is drawn."""
    parts = [section_heads(files, options, prompts), section_bodies(files, options)]
    bundles = files.select("bundle").distinct()
    if options.output_format == "xml":
        parts.append(_rows(bundles, TAIL, F.lit(_XML_TAIL)))
    elif options.output_format != "markdown" and options.show_tree:
        parts.append(tree_sizes(files).withColumn("part", F.lit(TREE)))
        parts.append(_rows(bundles, TREE_END, F.lit(RULE)))
    narrow = [p.select("bundle", "part", "chars", "lines") for p in parts]
    out = narrow[0]
    for rows in narrow[1:]:
        out = out.unionByName(rows)
    return out


def text_chars(output_format: str) -> Column:
    """The length of a bundle's text, as an aggregate over its sections."""
    if output_format != "xml":
        return F.sum("chars")
    return F.sum("chars") - 1 + index_digits(F.count_if(F.col("part") == BODY))


def in_order(
    sections: DataFrame,
    output_format: str,
    max_chars: int = SLOT_CHARS,
    sources: DataFrame | None = None,
    task_per_slot: bool = False,
) -> DataFrame:
    """Sections with ``slot`` and ``position``, XML bodies with their index."""
    xml = output_format == "xml"
    out = placed(sections, max_chars, sources, xml, task_per_slot)
    if xml:
        body = F.col("part") == BODY
        out = out.withColumn("section", F.when(body, with_index("section", F.col("index"))).otherwise(F.col("section")))
    return out.drop("index")


def number_sections(sections: DataFrame, output_format: str = "standard", max_chars: int = SLOT_CHARS) -> DataFrame:
    """``(bundle, ordinal, section)`` in the order of the text."""
    return in_order(sections, output_format, max_chars).select("bundle", F.col("position").alias("ordinal"), "section")


def all_bundles(
    sections: DataFrame,
    output_format: str = "standard",
    sources: DataFrame | None = None,
    max_chars: int = SLOT_CHARS,
) -> DataFrame:
    """Every bundle one after the other, a gap of two newlines after each.

    ``sources`` (bundle, source_ord) gives the order; without it names do.
    """
    gap = "" if output_format == "xml" else "\n"
    bundles = sections.select("bundle").distinct()
    rows = sections.unionByName(_rows(bundles, GAP, F.lit(gap)))
    if sources is None:
        sources = bundles.withColumn("source_ord", F.lit(0))
    return in_order(rows, output_format, max_chars, sources).select("position", "bundle", "section")


def bundle_text(
    sections: DataFrame, output_format: str = "standard", max_chars: int = 1 << 24
) -> DataFrame:
    """The bundle's text as ``(bundle, chunk, text)``; chunks join up exactly.

    A bundle under ``max_chars`` is one chunk, its whole text. A larger one is
    cut between sections, so no task holds more than a chunk and one section.
    """
    newline = F.lit("\n")
    if output_format == "xml":
        newline = F.when(F.col("part") == TAIL, "").otherwise("\n")
    rows = in_order(sections, output_format, max_chars).select(
        "bundle", "slot", F.struct("position", F.concat("section", newline).alias("piece")).alias("row")
    )
    return rows.groupBy("bundle", "slot").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda s: s["piece"]), "").alias("text")
    ).withColumnRenamed("slot", "chunk")
