"""Token estimate, cost and budget expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from bindery.options import DEFAULT_PRICE, PRICES_PER_MILLION


def estimate(chars: Column) -> Column:
    """Four characters to a token, rounded down."""
    return F.floor(chars / 4).cast("bigint")


def lookup_literal(key: Column, table: Mapping[str, object], default: object) -> Column:
    """A constant table of a few entries as an expression."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def price(model: Column, prices: Mapping[str, float] = PRICES_PER_MILLION) -> Column:
    return lookup_literal(model, prices, DEFAULT_PRICE)


def cost(tokens: Column, model: Column) -> Column:
    return tokens / F.lit(1_000_000.0) * price(model)


def budget_percent(tokens: Column, hard: int) -> Column:
    return F.least(F.lit(100.0), tokens / F.lit(hard) * 100)


def budget_status(tokens: Column, soft: int, hard: int) -> Column:
    return (
        F.when(tokens > hard, "over_hard").when(tokens > soft, "over_soft").otherwise("ok")
    )
