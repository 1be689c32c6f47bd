"""Percentages and bar sizes of the report panels."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def bot_pct(total: Column, bots: Column) -> Column:
    """Whole bot percentage, halves rounded up; 0 when there is nothing."""
    share = F.round(F.least(bots, total) / total * 100)
    return F.when(total == 0, F.lit(0)).otherwise(share).cast("bigint")


def human_pct(total: Column, bots: Column) -> Column:
    return F.lit(100).cast("bigint") - bot_pct(total, bots)


def estimated_bot_visitors(visitors: Column, hits: Column, bot_hits: Column) -> Column:
    """Visitors split in the proportion of the hits, cut to a whole number."""
    estimate = F.floor(visitors.cast("double") * bot_hits / hits)
    return F.when(hits == 0, F.lit(0)).otherwise(estimate).cast("bigint")


def share_of_max(value: Column, *series: str) -> Column:
    """Size of a bar against the highest bar of its series, in percent.

    Meant for zero-filled calendar series, whose length is bounded (24 hours,
    31 days or 12 months), so one window partition is always small.
    """
    highest = F.max(value).over(Window.partitionBy(*series))
    return value / F.greatest(highest, F.lit(1)) * 100
