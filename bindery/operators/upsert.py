"""Keyed merge of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], merge: bool = True) -> DataFrame:
    """Incoming rows replace all old rows of their keys; without ``merge`` the whole table.

    A key may have several rows, such as the settings of one profile: those the
    incoming side lacks go as well. A null in an incoming row is kept.
    """
    if not merge:
        return new.select(*old.columns)
    incoming = new.select(*keys).distinct()
    return old.join(incoming, list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
