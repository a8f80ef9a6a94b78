"""Decoding and small text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Stands in for a genuine U+FFFD while malformed bytes are dropped.
_KEEP = "\ufdd0\ufdd1\ufdd0"
_MARK = "\ufffd"


# White space and its opposite as Unicode has them, plus 1C to 1F. The (?U) flag
# makes the class mean the same in every Java version.
SPACE = r"[\s\x1c-\x1f]"
INK = r"[^\s\x1c-\x1f]"
# Borders of words made of letters, digits and underscore of any script, where
# the character after (before) the border is known to be ASCII.
_WORD, _ASCII = r"[\p{L}\p{N}_]", "[A-Za-z0-9_]"
BORDER_BEFORE = rf"(?:(?<!{_ASCII})(?={_ASCII})(?<!{_WORD})|(?!{_ASCII})(?={{start}})(?<={_WORD}))"
BORDER_AFTER = rf"(?:(?<={_ASCII})(?!{_WORD})|(?<!{_ASCII})(?={_WORD}))"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` standing once in the plan.

    A filter on the result of chained stages is rewritten below them by putting
    each stage's definition in place of its column. Stages that name their input
    several times would make that expression grow with a power of the stages.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _shielded(raw: Column) -> Column:
    marked = F.replace(raw, F.lit(_MARK), F.lit(_KEEP))
    cleaned = F.replace(F.make_valid_utf8(marked), F.lit(_MARK), F.lit(""))
    return F.replace(cleaned, F.lit(_KEEP), F.lit(_MARK))


def _unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def decode(content: Column) -> Column:
    """UTF-8 text with malformed bytes dropped and newlines made ``\\n``."""
    valid = bind(
        content.cast("string"),
        lambda raw: F.when(F.is_valid_utf8(raw), raw).otherwise(_shielded(raw)),
    )
    return bind(
        valid, lambda t: F.when(F.contains(t, F.lit("\r")), _unix_lines(t)).otherwise(t)
    )


def is_binary(content: Column) -> Column:
    """A NUL in the first 1,024 bytes; unreadable counts as binary."""
    head = F.substring(content, 1, 1024)
    return content.isNull() | F.contains(head, F.lit(bytearray(b"\x00")))


def text_is_binary(text: Column) -> Column:
    """The same test for a table that already holds text."""
    return is_binary(F.encode(F.substring(text, 1, 1024), "UTF-8"))


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def title(key: Column) -> Column:
    """``pii_sanitization`` to ``Pii Sanitization``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
