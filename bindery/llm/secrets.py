"""Secret scans: keyword automaton, anchored patterns at its hits, checksums.

An Aho-Corasick automaton reads each text once. Only where one of its keywords
ends is a pattern tried, anchored at the keyword. Token formats that carry a
checksum count only if it holds, which keeps look-alikes out. Hex runs have no
keyword; one linear scan finds them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

BASE = ("assign", "access", "hex")
#: In this order kinds follow each other at the same start.
KINDS = (*BASE, "github", "npm", "card")

# Formats as their issuers publish them.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CARD = re.compile(r"card(?:\x20?(?:number|no\.?))?[\x20:=#]{1,4}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", re.I | re.ASCII)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "card": "card",
}
_LOWER = {c: c + 32 for c in range(65, 91)}


def crc_holds(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the first thirty, in base 62."""
    value, digits = zlib.crc32(match[1].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == match[2]


def luhn_holds(match: re.Match) -> bool:
    """The card number's check digit is right."""
    digits = [int(c) for c in match[1] if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


#: Pattern, what a match must pass, and whether a match that fails still uses up its text.
RULES = {
    "assign": (ASSIGN, lambda m: m.end(2) - m.start(2) >= 12, True),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 18, True),
    "github": (GITHUB, crc_holds, False),
    "npm": (NPM, crc_holds, False),
    "card": (CARD, luhn_holds, False),
}


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place in ``KINDS``, end) in code points, sorted."""
    lowered = text.lower()
    if len(lowered) != len(text):  # some capitals grow; positions must stay
        lowered = text.translate(_LOWER)
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in automaton.iter(lowered):
        starts.setdefault(kind, []).append(end - length + 1)
    spans = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    for kind, found in starts.items():
        pattern, passes, uses_up = RULES[kind]
        free = 0
        for start in sorted(set(found)):
            if start >= free and (match := pattern.match(text, start)):
                good = passes(match)
                if good:
                    spans.append((start, KINDS.index(kind), match.end()))
                if good or uses_up:
                    free = match.end()
    return sorted(spans)


SPANS = ArrayType(StructType().add("start", IntegerType()).add("kind", StringType()).add("end", IntegerType()))


@F.pandas_udf(SPANS)
def secret_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The spans of each text by start, then kind; none for null."""
    automaton = keyword_automaton()
    for batch in texts:
        yield pd.Series(
            [
                [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in find_spans(t, automaton)] if t else []
                for t in batch
            ],
            index=batch.index,
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets``, an array of (start, kind, end) in code points.

    Null and empty texts have none. Other columns, repeated rows and null ids
    pass through; a column already named ``secrets`` is replaced. Every text is
    scanned whole; the scan is one narrow stage without a shuffle.
    """
    return docs.withColumn("secrets", secret_spans(F.col("text")))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans, per document."""
    found = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
    )
