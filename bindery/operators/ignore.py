"""Ignore rules: the last matching rule decides.

Rules are met by equality, not one by one. By its shape a rule is

- a *name* that any folder or file on the way may have (``build``, ``build/``),
- an *extension* that one may end with (``*.log``),
- a *path* from the root (``/docs/a``, ``docs/a/``), which all below it starts with,
- or a *pattern*, for everything else.

A path asks for its names, extensions and prefixes; these are joined to the
rules, and only patterns are tried on paths, compiled once per batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from bindery.functions.paths import components
from bindery.functions.wildcards import rule_regex

NAME, EXTENSION, PATH, PATTERN = "name", "extension", "path", "pattern"


def ignored_by(rel_path: Column, lines: Iterable[str]) -> Column:
    """One folder's rules as a single expression, tried from the last up."""
    rules = [rule for rule in map(rule_regex, lines) if rule]
    branches = [
        F.when(rel_path.rlike(regex), F.lit(not negated)) for regex, negated in reversed(rules)
    ]
    return F.coalesce(*branches, F.lit(False))


def _literal(text: str) -> str | None:
    """``text`` without its escapes, or None if it holds a wildcard."""
    plain = re.sub(r"\\(.)", "", text)
    return None if re.search(r"[*?\[]", plain) or plain.endswith("\\") else re.sub(r"\\(.)", r"\1", text)


def shape(line: str) -> tuple[str, str, bool, bool] | None:
    """A rule as (kind, what to ask for, folders only, negated); None for a line without one.

    Raises ``ValueError`` for a rule that cannot be read.
    """
    parsed = rule_regex(line)
    if parsed is None:
        return None
    regex, negated = parsed
    rule = line.rstrip("\r\n")
    while rule.endswith(" ") and not rule.endswith("\\ "):
        rule = rule[:-1]
    rule = rule[1:] if negated else rule
    folders_only = rule.endswith("/")
    parts = [p for p in rule.split("/") if p]
    whole = [_literal(p) for p in parts]
    if "/" in rule[:-1]:
        if None not in whole:
            return PATH, "/".join(whole), folders_only, negated
    elif whole[0] is not None:
        return NAME, whole[0], folders_only, negated
    elif parts[0].startswith("*.") and (ending := _literal(parts[0][1:])):
        return EXTENSION, ending, folders_only, negated
    return PATTERN, regex, False, negated


def _shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["kind", "asked", "folders_only", "negated", "bad"]

    def one(line: str) -> tuple:
        try:
            return (*(shape(line) or (None,) * 4), False)
        except ValueError:
            return (None,) * 4 + (True,)

    for batch in batches:
        rows = pd.DataFrame(batch["pattern"].map(one).tolist(), columns=columns, index=batch.index)
        rows = pd.concat([batch[["bundle", "ord"]], rows], axis=1)
        yield rows[rows["kind"].notna() | rows["bad"]]


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rule lines ``(bundle, ord, pattern)`` as (bundle, ord, kind, asked, folders_only, negated).

    A bundle with a rule that cannot be read has no rules: ``usable_lines`` finds
    such files beforehand.
    """
    shaped = rules.select("bundle", "ord", "pattern").mapInPandas(
        _shaped, "bundle string, ord int, kind string, asked string, folders_only boolean, negated boolean, bad boolean"
    )
    bad = shaped.filter("bad").select(F.col("bundle").alias("_bundle")).distinct()
    return shaped.filter("not bad").join(bad, F.col("bundle").eqNullSafe(F.col("_bundle")), "left_anti").drop("bad")


@F.pandas_udf(BooleanType())
def usable_lines(files: pd.Series) -> pd.Series:
    """Whether every line of an ignore file can be read as a rule."""

    def bad(line: str) -> bool:
        try:
            rule_regex(line)
            return False
        except ValueError:
            return True

    return files.map(lambda lines: not any(map(bad, lines)))


def questions(rel_path: Column) -> Column:
    """What a path asks for: (kind, asked, is_file) for each name, extension and prefix of it."""
    parts = components(rel_path)
    depth = F.size(parts)

    def asked(kind: str, text: Column, level: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("asked"), (level == depth).alias("is_file"))

    names = F.transform(parts, lambda name, i: asked(NAME, name, i + 1))
    prefixes = F.transform(
        F.sequence(F.lit(1), depth), lambda level: asked(PATH, F.array_join(F.slice(parts, F.lit(1), level), "/"), level)
    )

    def endings(name: Column, i: Column) -> Column:
        pieces = F.split(name, r"\.")
        return F.transform(
            F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda at: at > 1),
            lambda at: asked(EXTENSION, F.concat(F.lit("."), F.array_join(F.slice(pieces, at, F.size(pieces)), ".")), i + 1),
        )

    return F.concat(names, prefixes, F.flatten(F.transform(parts, endings)))


@F.pandas_udf(StructType().add("ord", IntegerType()).add("negated", BooleanType()))
def last_pattern(paths: pd.Series, rules: pd.Series) -> pd.DataFrame:
    """The last of a bundle's patterns, highest first, that a path matches."""
    compiled: dict[str, re.Pattern] = {}
    out = []
    for path, own in zip(paths, rules):
        found = (None, None)
        for rule in own:
            regex = rule["asked"]
            if regex not in compiled:
                compiled[regex] = re.compile(regex.removesuffix(r"\z") + r"\Z")
            if compiled[regex].match(path):
                found = (rule["ord"], rule["negated"])
                break
        out.append(found)
    return pd.DataFrame(out, columns=["ord", "negated"]).astype({"ord": "Int32", "negated": "boolean"})


def mark_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``ignored`` to files, each tested against the rules of its own bundle.

    All joins are on narrow rows, (bundle, rel_path); Spark's size check decides which
    of them broadcast the rules.
    """
    table = compile_rules(rules)
    found = F.struct("ord", "negated")
    paths = files.select("bundle", "rel_path").distinct()
    exact = (
        table.filter(F.col("kind") != PATTERN)
        .groupBy(F.col("bundle").alias("_bundle"), "kind", "asked")
        .agg(
            F.max(F.when(~F.col("folders_only"), found)).alias("on_any"),
            F.max(F.when(F.col("folders_only"), found)).alias("on_folders"),
        )
    )
    asking = paths.select("bundle", "rel_path", F.inline(questions(F.col("rel_path"))))
    met = asking.alias("q").join(
        exact.alias("r"),
        F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("q.kind") == F.col("r.kind")) & (F.col("q.asked") == F.col("r.asked")),
    ).select("bundle", "rel_path", F.when(F.col("is_file"), F.col("on_any")).otherwise(F.greatest("on_any", "on_folders")).alias("hit"))
    # As long as one folder's ignore file.
    patterns = (
        table.filter(F.col("kind") == PATTERN)
        .groupBy(F.col("bundle").alias("_bundle"))
        .agg(F.sort_array(F.collect_list(F.struct("ord", "negated", "asked")), asc=False).alias("patterns"))
    )
    tried = paths.join(patterns, F.col("bundle").eqNullSafe(F.col("_bundle"))).select(
        "bundle", "rel_path", last_pattern("rel_path", "patterns").alias("hit")
    )
    last = (
        met.unionByName(tried)
        .filter("hit.ord is not null")
        .groupBy(F.col("bundle").alias("_bundle"), F.col("rel_path").alias("_path"))
        .agg(F.max("hit").alias("_hit"))
    )
    same = F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("rel_path") == F.col("_path"))
    return files.join(last, same, "left").select(
        *[F.col(c) for c in files.columns], F.coalesce(~F.col("_hit.negated"), F.lit(False)).alias("ignored")
    )
