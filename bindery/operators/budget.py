"""Running token totals over the bundles of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindery.functions import tokens
from bindery.operators.ordering import number_rows
from bindery.options import Options


def running_budget(stats: DataFrame, order: list[str], options: Options) -> DataFrame:
    """Tokens so far, cost, percent of the hard limit and status, in run order.

    ``stats`` has a row for every source, those without tokens too: progress
    counts sources.
    """
    keys = stats.select(*dict.fromkeys(["bundle", *order, "token_count"]))
    numbered = number_rows(keys, [], order, ["token_count"])
    running = F.col("token_count_before") + F.col("token_count")
    return numbered.withColumn("running_tokens", running).select(
        "bundle",
        F.concat("row_no", F.lit("/"), "group_rows").alias("progress"),
        "token_count",
        "running_tokens",
        F.round(tokens.cost(F.col("running_tokens"), F.lit(options.model)), 8).alias("running_cost"),
        F.round(tokens.budget_percent(F.col("running_tokens"), options.hard_limit), 4).alias(
            "budget_percent"
        ),
        tokens.budget_status(
            F.col("running_tokens"), options.soft_limit, options.hard_limit
        ).alias("status"),
    )
