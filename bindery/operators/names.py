"""Many names at once: one automaton pass finds which can occur, the chain runs for these.

The chain replaces names one after the other, each on the text the earlier ones
left. So a name is a candidate if it is in the text, in any case, or if it could
match the mark of an earlier name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: No character from here on has a case.
CASED = 0x1F000


@cache
def case_folds() -> dict[int, str]:
    """Every character whose upper, then lower case is another single character."""
    out = {}
    for code in range(CASED):
        char = chr(code)
        upper = char.upper() if len(char.upper()) == 1 else char
        lower = upper.lower()[0]  # of a letter that turns into letter and dot, the letter
        if lower != char:
            out[code] = lower
    return out


@cache
def lower_case_left() -> tuple[re.Pattern, dict[int, str]]:
    """What lower-casing leaves or makes different from ``case_folds``, and a pattern to find it."""
    folds = case_folds()
    left = {}
    for code in range(CASED):
        low, fold = chr(code).lower(), folds.get(code, chr(code))
        if len(low) == 1 and low != fold:
            left[ord(low)] = fold
    return re.compile("[" + "".join(map(re.escape, map(chr, left))) + "]"), left


def folded(text: str) -> str:
    """``text`` such that names equal in any case are equal."""
    if text.isascii():
        return text.lower()
    pattern, left = lower_case_left()
    text = text.replace("\u0130", "i").lower()  # the one letter that lower-casing makes two
    return text.translate(left) if pattern.search(text) else text


def may_match_a_mark(name: str) -> bool:
    """Whether a folded name can match in a mark ``<USER_n>`` or across its border."""
    letters = name.rstrip("0123456789")
    inside = "user_".endswith(letters) if letters != name else letters in "user_"
    return "<" in name or ">" in name or inside


@lru_cache(maxsize=4)
def automaton(names: tuple[str, ...]):
    """Over the folded names; each ends in the places of the names that fold to it."""
    import ahocorasick  # needed for many names alone

    places: dict[str, list[int]] = {}
    for i, name in enumerate(names, 1):
        places.setdefault(folded(name), []).append(i)
    out = ahocorasick.Automaton()
    for name, own in places.items():
        if name:
            out.add_word(name, own)
    out.make_automaton()
    return out


def names_in(text: str, names: tuple[str, ...]) -> Iterable[int]:
    return {i for _, own in automaton(names).iter(folded(text)) for i in own}


def candidates(text: Column, names: Sequence[str]) -> Column:
    """The numbers, from 1, of the names the chain has to try on ``text``, in order."""
    listed = tuple(names)
    always = {i for i, name in enumerate(listed, 1) if not name or may_match_a_mark(folded(name))}

    @F.pandas_udf(ArrayType(IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        found = [set(names_in(t, listed)) if t is not None else set() for t in texts]
        return pd.Series([sorted(f | always) for f in found], index=texts.index)

    return find(text)


def replace_names(
    df: DataFrame, names: Sequence[str], patterns: Sequence[str], marks: Sequence[str], column: str, found: str
) -> DataFrame:
    """Replace the names in order; ``found`` lists the numbers of those that were there."""
    shapes, by = (F.array(*map(F.lit, x)) for x in (patterns, marks))
    none = F.array().cast("array<int>")

    def step(state: Column, i: Column) -> Column:
        shape = F.get(shapes, i - 1)
        return F.when(
            F.regexp_like(state["text"], shape),
            F.struct(
                F.regexp_replace(state["text"], shape, F.get(by, i - 1)).alias("text"),
                F.concat(state["found"], F.array(i)).alias("found"),
            ),
        ).otherwise(state)

    others = [c for c in df.columns if c != column]
    start = F.struct(F.col(column).alias("text"), none.alias("found"))
    return (
        df.withColumn(found, candidates(F.col(column), names))
        .withColumn(found, F.aggregate(found, start, step))
        .select(*others, F.col(found)["text"].alias(column), F.col(found)["found"].alias(found))
    )
