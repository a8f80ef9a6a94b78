"""Path pieces and path predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from bindery.functions.wildcards import segment_regex
from bindery.options import ARCHIVE_NAMES


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case, ``''`` for none; ``.env`` has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def components(path: Column) -> Column:
    """Path as an array; ordering by it puts ``a/b`` before ``a.txt``."""
    return F.split(path, "/")


def display_path(top: Column, root: Column, path: Column) -> Column:
    """``top/rel`` below the root, ``top/name`` elsewhere."""
    below = F.startswith(path, F.concat(root, F.lit("/")))
    rel = F.substring(path, F.length(root) + 2, F.length(path))
    return F.concat_ws("/", top, F.when(below, rel).otherwise(file_name(path)))


def in_archive(path: Column) -> Column:
    """True when any folder above the file has an archive name."""
    return F.lower(path).rlike(f"(?:^|/)(?:{'|'.join(ARCHIVE_NAMES)})/")


def is_sensitive(path: Column, patterns: Sequence[str]) -> Column:
    """Names match in any case; plain patterns also match the end of the path as they are.

    One expression over the path, so a computed path is not repeated per pattern.
    """
    names = "|".join(segment_regex(p, "[^/]") for p in patterns if "/" not in p)
    ends = "|".join(segment_regex(p, "[^/]") for p in patterns if "*" not in p)
    tests = [rf"(?:\A|/)(?iu:{names})\z"] if names else []
    tests += [rf"(?:{ends})\z"] if ends else []
    return path.rlike("(?s)" + "|".join(tests)) if tests else F.lit(False)
