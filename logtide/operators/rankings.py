"""Sorted and cut lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import shares
from logtide.functions.calendars import GRAIN_COLUMNS
from logtide.schema import ASSET_EXTENSIONS, PAGE_CATEGORY


def top_by_hits(rows: DataFrame, grain: str, name: str, limit: int) -> DataFrame:
    """The ``limit`` rows with most hits per site and period, with their rank.

    Equal hits rank by name. Spark cuts every partition to the limit before the
    window's shuffle, so a site with most of the rows costs no more than others.
    """
    period = Window.partitionBy("domain", GRAIN_COLUMNS[grain])
    rank = F.row_number().over(period.orderBy(F.desc("hits"), F.asc(name)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def with_split(pages: DataFrame) -> DataFrame:
    """Page rows with the human and bot share of their hits."""
    hits, bot_hits = F.col("hits"), F.col("bot_hits")
    return pages.withColumn("human_pct", shares.human_pct(hits, bot_hits)).withColumn(
        "bot_pct", shares.bot_pct(hits, bot_hits)
    )


def content_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("category") == PAGE_CATEGORY)


def top_content_pages(pages: DataFrame, grain: str, limit: int) -> DataFrame:
    """The most visited content pages per site and period."""
    ranked = top_by_hits(content_pages(pages), grain, "path", limit)
    return with_split(ranked).select(
        "domain",
        GRAIN_COLUMNS[grain],
        "rank",
        "path",
        "hits",
        "visitors",
        "human_pct",
        "bot_pct",
    )


def static_assets(pages: DataFrame, grain: str) -> DataFrame:
    """All static files, by category in report order and by hits within it.

    The list has no limit, so it is sorted by range over the cluster.
    """
    key = GRAIN_COLUMNS[grain]
    order = F.array_position(F.array(*[F.lit(c) for c in ASSET_EXTENSIONS]), F.col("category"))
    assets = pages.where(F.col("category") != PAGE_CATEGORY)
    return (
        with_split(assets)
        .orderBy("domain", key, order, F.desc("hits"), "path")
        .select("domain", key, "category", "path", "hits", "visitors", "human_pct", "bot_pct")
    )
