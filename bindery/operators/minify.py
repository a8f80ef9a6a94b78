"""Blank lines, comments and inner white space removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions.text import INK, bind
from bindery.functions.tokens import lookup_literal

# Language by suffix, and the comment families.
LANGUAGE_BY_SUFFIX = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".rb": "ruby", ".sh": "bash",
}
DEFAULT_LANGUAGE = "python"
HASH_LANGUAGES = ("python", "bash", "ruby")
SLASH_LANGUAGES = ("javascript", "typescript", "java", "c", "cpp")

_BLANK = r"[\s\x1c-\x1f&&[^\n]]"
_RARE = r"[\s\x1c-\x1f&&[^\n ]]"
# Holds every rare blank and more, but is quicker to look for.
_MAYBE_RARE = r"[\t\x0b\f\r\x1c-\x1f\x85\xa0\u1680-\x{10FFFF}]"


def language(ext: Column) -> Column:
    return lookup_literal(ext, LANGUAGE_BY_SUFFIX, DEFAULT_LANGUAGE)


def _even(line: Column, quote: str) -> Column:
    count = F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))
    return count % 2 == 0


def _without_hash(line: Column) -> Column:
    """A ``#`` line goes, a ``#!`` line stays, an inline ``#`` is cut if quotes pair up."""
    return (
        F.when(~F.contains(line, F.lit("#")), line)
        .when(line.rlike(rf"(?U)\A{_BLANK}*#!"), line)
        .when(line.rlike(rf"(?U)\A{_BLANK}*#"), F.lit(""))
        .when(_even(line, '"') & _even(line, "'"), F.substring_index(line, "#", 1))
        .otherwise(line)
    )


def strip_hash_comments(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), _without_hash)
    return F.when(F.contains(text, F.lit("#")), F.array_join(lines, "\n")).otherwise(text)


def strip_slash_comments(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("//")), F.regexp_replace(text, r"//[^\n]*", "")
    ).otherwise(text)


def _replace_if(needle: str, pattern: str, mark: str) -> Callable[[Column], Column]:
    """Replace ``pattern`` in texts that hold the needle, a last or a rare blank."""

    def step(text: Column) -> Column:
        test = (
            F.contains(text, F.lit(needle))
            | F.endswith(text, F.lit(" "))
            | text.rlike(_MAYBE_RARE)
        )
        return F.when(test, F.regexp_replace(text, F.lit(pattern), F.lit(mark))).otherwise(text)

    return step


def squeeze(text: Column) -> Column:
    """Indent kept, inner runs to one space, line ends trimmed, blank lines dropped.

    Plain prose has nothing to squeeze; cheap tests spare it the replacements.
    """
    inner = rf"(?U)(?={_BLANK})(?<={INK})(?:{_BLANK}{{2,}}|{_RARE})(?={INK})"
    ends = rf"(?U)(?={_BLANK})(?<!{_BLANK}){_BLANK}++(?=\n|\z)"
    text = bind(text, _replace_if("  ", inner, " "))
    text = bind(text, _replace_if(" \n", ends, ""))
    return F.btrim(F.regexp_replace(text, "\n{2,}", "\n"), F.lit("\n"))


def minify(df: DataFrame, column: str = "text", lang: str = "language") -> DataFrame:
    """Minify ``column`` by the comment family of ``lang``."""
    name = F.col(lang)
    bare = bind(
        F.col(column),
        lambda text: F.when(name.isin(*HASH_LANGUAGES), strip_hash_comments(text))
        .when(name.isin(*SLASH_LANGUAGES), strip_slash_comments(text))
        .otherwise(text),
    )
    return df.withColumn(column, squeeze(bare))


def reduction(df: DataFrame, old: str, new: str, by: str) -> DataFrame:
    """Percent by which ``sum(new)`` is below ``sum(old)`` per group."""
    return (
        df.groupBy(by)
        .agg(F.sum(old).cast("bigint").alias(old), F.sum(new).cast("bigint").alias(new))
        .withColumn("reduction_pct", F.round((1 - F.col(new) / F.col(old)) * 100, 1))
    )
