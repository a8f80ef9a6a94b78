"""Redaction of names, emails, keys and secrets, with what was found."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions.text import BORDER_AFTER, BORDER_BEFORE, SPACE, bind
from bindery.operators.names import replace_names

# Patterns and placeholders.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
API_KEYS = (
    (r"\bsk-[A-Za-z0-9]{48}\b", "OpenAI API key"),
    (r"\bAKIA[0-9A-Z]{16}\b", "AWS Access Key"),
    (r"\bxoxb-[0-9]+-[0-9]+-[A-Za-z0-9]+\b", "Slack Bot Token"),
    (r"\bghp_[A-Za-z0-9]{36}\b", "GitHub Personal Access Token"),
)
VALUE_CHARS = r"[A-Za-z0-9!@#$%^&*()_+\-=\[\]{};:,.<>?]"
PASSWORD_WORDS, PASSWORD_LENGTH = "password|pwd|passwd|pass", 8
SECRET_WORDS, SECRET_LENGTH = "secret|token|key", 16
EMAIL_MARK = "<EMAIL_ADDRESS>"
KEY_MARK = "<REDACTED_API_KEY>"
SECRET_MARK = "<REDACTED_SECRET>"

#: More names than this are looked for in one pass; the result is the same.
FEW_NAMES = 8

# Characters beyond A-Z that fold to a letter of the words or of the value.
_FOLDS = {"s": "\u017f", "k": "\u212a"}
_VALUE_FOLDS = "\u017f\u212a\u0131\u0130"


def bordered(pattern: str) -> tuple[str, str]:
    """A ``\\b…\\b`` pattern as ``(exact, hint)``.

    The exact one has borders of Unicode words. The hint is cheap and found in
    every text with a match.
    """
    body = pattern[2:-2]
    start = body[: body.index("]") + 1] if body[0] == "[" else body[: body.index("[")]
    hint = body.replace("]+@", "]@", 1)
    before = BORDER_BEFORE.replace("{start}", start)
    if body[0] != "[":
        before = f"(?={start})" + before
    return before + body.replace("]+@", "]++@", 1) + BORDER_AFTER, hint


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}{_FOLDS.get(c, '')}]" for c in word)


def assignment(words: str, length: int) -> str:
    """Keyword, separator, value; case spelled out, which runs faster than a flag."""
    keywords = [_any_case(w) for w in words.split("|")]
    first = "".join(dict.fromkeys(k[1 : k.index("]")] for k in keywords))
    value = VALUE_CHARS[:-1] + _VALUE_FOLDS + "]"
    return (
        rf"(?U)(?=[{first}])({'|'.join(keywords)}){SPACE}*[=:]{SPACE}*"
        rf"[\"']?({value}{{{length},}})[\"']?"
    )


def numbered_names(names: Sequence[str]) -> list[tuple[int, str]]:
    """Distinct names in sorted order, numbered from 1."""
    return list(enumerate(sorted(set(names)), 1))


def name_pattern(name: str) -> str:
    return "(?iu)" + "".join(
        "\\" + c if c.isascii() and not c.isalnum() else c for c in name
    )


def _stage(
    df: DataFrame,
    column: str,
    found: str,
    pattern: str,
    mark: str,
    count: Callable[[Column], Column],
) -> DataFrame:
    """Count the matches into ``found``, then rewrite only texts that have some."""
    counted = bind(
        F.col(column), lambda t: F.struct(count(t).cast("int").alias("n"), t.alias("t"))
    )
    rewritten = bind(
        F.col(found),
        lambda s: F.when(
            s["n"] > 0, F.regexp_replace(s["t"], F.lit(pattern), F.lit(mark))
        ).otherwise(s["t"]),
    )
    others = [c for c in df.columns if c != column]
    return df.withColumn(found, counted).select(
        *others, rewritten.alias(column), F.col(found)["n"].alias(found)
    )


def redact_names(df: DataFrame, names: Sequence[str], column: str = "text") -> DataFrame:
    """Replace each name, any case, by its numbered mark.

    Adds ``_name_i`` for each name, or ``_names`` with the numbers of those found.
    """
    numbered = numbered_names(names)
    if len(numbered) > FEW_NAMES:
        listed = [name for _, name in numbered]
        marks = [f"<USER_{i}>" for i, _ in numbered]
        return replace_names(df, listed, [name_pattern(n) for n in listed], marks, column, "_names")
    for i, name in numbered:
        pattern = name_pattern(name)
        df = _stage(
            df, column, f"_name_{i}", pattern, f"<USER_{i}>", lambda t, p=pattern: t.rlike(p)
        )
    return df


def redact_emails(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``_emails``, the distinct addresses of the text."""
    pattern, hint = bordered(EMAIL)

    def distinct(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        likely = F.contains(text, F.lit("@")) & text.rlike(hint)
        return F.when(likely, F.size(found)).otherwise(0)

    return _stage(df, column, "_emails", pattern, EMAIL_MARK, distinct)


def redact_api_keys(df: DataFrame, column: str = "text") -> DataFrame:
    """Four kinds in turn; adds ``_key_i``, whether the kind was found."""
    for i, (shape, _) in enumerate(API_KEYS):
        pattern, hint = bordered(shape)

        def has_key(text: Column, hint: str = hint, pattern: str = pattern) -> Column:
            start = F.contains(text, F.lit(hint[: hint.index("[")]))
            return start & text.rlike(hint) & text.rlike(pattern)

        df = _stage(df, column, f"_key_{i}", pattern, KEY_MARK, has_key)
    return df


def _redact_assignments(df: DataFrame, column: str, found: str, words: str, length: int) -> DataFrame:
    pattern = assignment(words, length)

    def matches(text: Column) -> Column:
        separator = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
        return F.when(separator, F.regexp_count(text, F.lit(pattern))).otherwise(0)

    return _stage(df, column, found, pattern, "$1=" + SECRET_MARK, matches)


def redact_passwords(df: DataFrame, column: str = "text") -> DataFrame:
    return _redact_assignments(df, column, "_passwords", PASSWORD_WORDS, PASSWORD_LENGTH)


def redact_secrets(df: DataFrame, column: str = "text") -> DataFrame:
    return _redact_assignments(df, column, "_secrets", SECRET_WORDS, SECRET_LENGTH)


def _finding(kind: str, n: Column, message: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), n.cast("bigint").alias("n"), message.alias("message")
    )


def findings(names: Sequence[str]) -> Column:
    """The redaction records of a text whose stages have run."""
    records, named = [], []
    numbered = numbered_names(names)
    if len(numbered) > FEW_NAMES:
        messages = F.array(*[F.lit(f"Replaced '{name}' with <USER_{i}>") for i, name in numbered])
        named = [F.transform("_names", lambda i: _finding("name", F.lit(1), F.get(messages, i - 1)))]
        numbered = []
    for i, name in numbered:
        message = F.lit(f"Replaced '{name}' with <USER_{i}>")
        records.append(_finding("name", F.col(f"_name_{i}"), message))
    emails = F.concat(F.lit("Redacted "), F.col("_emails"), F.lit(" email address(es)"))
    records.append(_finding("email", F.col("_emails"), emails))
    for i, (_, kind) in enumerate(API_KEYS):
        records.append(
            _finding("api_key", F.col(f"_key_{i}"), F.lit(f"Redacted {kind}"))
        )
    for kind, count in (("password", "_passwords"), ("secret", "_secrets")):
        message = F.concat(
            F.lit("Redacted "), F.col(count), F.lit(" password/secret assignment(s)")
        )
        records.append(_finding(kind, F.col(count), message))
    return F.concat(*named, F.filter(F.array(*records), lambda r: r["n"] > 0))


def redact(df: DataFrame, names: Sequence[str] = (), column: str = "text") -> DataFrame:
    """All stages in order, each on the one before; adds ``redactions``."""
    columns = df.columns
    df = redact_names(df, names, column)
    for stage in (redact_emails, redact_api_keys, redact_passwords, redact_secrets):
        df = stage(df, column)
    return df.select(*columns, findings(names).alias("redactions"))


def redaction_counts(redacted: DataFrame) -> DataFrame:
    """Items and messages per bundle and kind.

    The outer explode keeps Spark from testing the array below the text stages.
    """
    return (
        redacted.select("bundle", F.explode_outer("redactions").alias("r"))
        .filter(F.col("r").isNotNull())
        .groupBy("bundle", F.col("r.kind").alias("kind"))
        .agg(F.sum("r.n").alias("n"), F.count(F.lit(1)).alias("messages"))
    )


def redaction_log(redacted: DataFrame) -> DataFrame:
    """One ``path: message`` line per redaction."""
    exploded = redacted.select(
        "bundle", "display_path", F.posexplode_outer("redactions").alias("pos", "r")
    )
    return exploded.filter(F.col("r").isNotNull()).select(
        "bundle",
        "display_path",
        "pos",
        F.concat("display_path", F.lit(": "), "r.message").alias("line"),
    )
