"""Sites and bot patterns: the small configuration tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logtide.functions.requests import BotMap


@dataclass(frozen=True)
class Site:
    """One site: where its raw log lies and, if it has one, its sitemap file."""

    domain: str
    log_path: str | None = None
    sitemap: str | None = None


def select_sites(sites: Sequence[Site], domain: str | None = None) -> list[Site]:
    """All sites, or the one asked for; an unknown name is an error."""
    if domain is None:
        return list(sites)
    chosen = [site for site in sites if site.domain == domain]
    if not chosen:
        known = ", ".join(site.domain for site in sites)
        raise ValueError(f"site '{domain}' is not configured; known sites: {known}")
    return chosen


def local_table(spark: SparkSession, columns: dict[str, tuple[list, pa.DataType]]) -> DataFrame:
    """A DataFrame over configuration values.

    Built from Arrow so that it becomes a local relation of known size, which
    lets the planner see by itself that it is small enough to broadcast.
    """
    arrays = {name: pa.array(values, kind) for name, (values, kind) in columns.items()}
    return spark.createDataFrame(pa.table(arrays))


def sites_table(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """``(domain, log_path, sitemap)``, one row per site."""
    return local_table(
        spark,
        {
            "domain": ([s.domain for s in sites], pa.string()),
            "log_path": ([s.log_path for s in sites], pa.string()),
            "sitemap": ([s.sitemap for s in sites], pa.string()),
        },
    )


def bots_table(spark: SparkSession, bots: BotMap) -> DataFrame:
    """``(priority, pattern, bot_name)``; the lowest matching priority wins."""
    return local_table(
        spark,
        {
            "priority": (list(range(len(bots))), pa.int32()),
            "pattern": ([pattern for pattern, _ in bots], pa.string()),
            "bot_name": ([name for _, name in bots], pa.string()),
        },
    )
