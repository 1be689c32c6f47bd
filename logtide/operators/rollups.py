"""Counts per site and period.

A grain is ``day``, ``month`` or ``year``; its key column is ``dt``, ``month``
or ``year``. Exact distinct counts are two plain aggregations, first to one row
per address, then to the period. Both combine on the map side, so a site, path
or address that holds a large part of the rows sends one row per task and key
through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import requests as rq
from logtide.functions.calendars import (
    GRAIN_COLUMNS,
    DateLike,
    date_column,
    period_label,
    period_start,
)
from logtide.operators.requests import hits


def by_period(rows: DataFrame, grain: str, keys: list[str], *measures: Column) -> DataFrame:
    """Aggregate rows that carry ``domain`` and ``dt`` to (site, period, keys)."""
    start = period_start(F.col("dt"), grain).alias("period_start")
    grouped = rows.groupBy("domain", start, *keys).agg(*measures)
    label = period_label(F.col("period_start"), grain).alias(GRAIN_COLUMNS[grain])
    values = [c for c in grouped.columns if c not in ("domain", "period_start")]
    return grouped.select("domain", label, *values)


# --- visitors and totals ----------------------------------------------------


def visitors(requests: DataFrame, grain: str = "day") -> DataFrame:
    """One row per (site, period, address) with its hits and bot hits."""
    return by_period(
        hits(requests),
        grain,
        ["c_ip"],
        F.count("*").alias("hits"),
        F.count("bot_name").alias("bot_hits"),
    )


def visitor_days(requests: DataFrame) -> DataFrame:
    """The visitor table: an address is a bot if any of its hits that day was one."""
    return visitor_days_of(visitors(requests))


def visitor_days_of(visitor_rows: DataFrame) -> DataFrame:
    """The visitor table from daily visitors with their hits and bot hits."""
    return visitor_rows.select("domain", "dt", "c_ip", (F.col("bot_hits") > 0).alias("is_bot"))


def traffic(requests: DataFrame, grain: str = "day") -> DataFrame:
    """Hits and exact unique visitors per site and period, straight from the log.

    A month or a year goes from the log to one row per address in one step; it
    does not pass through the days.
    """
    return traffic_of(visitors(requests, grain), grain)


def traffic_of(visitor_rows: DataFrame, grain: str = "day") -> DataFrame:
    """The same from one row per (site, period, address)."""
    return visitor_rows.groupBy("domain", GRAIN_COLUMNS[grain]).agg(
        F.sum("hits").alias("hits"),
        F.count("*").alias("visitors"),
        F.sum("bot_hits").alias("bot_hits"),
        F.count_if(F.col("bot_hits") > 0).alias("bot_visitors"),
    )


def range_visitors(visitor_table: DataFrame, first: DateLike, last: DateLike) -> DataFrame:
    """Exact unique visitors of any inclusive day range, from visitor rows."""
    in_range = visitor_table.where(F.col("dt").between(date_column(first), date_column(last)))
    addresses = in_range.groupBy("domain", "c_ip").agg(F.bool_or("is_bot").alias("is_bot"))
    return addresses.groupBy("domain").agg(
        F.count("*").alias("visitors"), F.count_if("is_bot").alias("bot_visitors")
    )


def period_visitors(visitor_table: DataFrame, grain: str) -> DataFrame:
    """Exact unique visitors per site and period, from visitor rows."""
    addresses = by_period(visitor_table, grain, ["c_ip"], F.bool_or("is_bot").alias("is_bot"))
    return addresses.groupBy("domain", GRAIN_COLUMNS[grain]).agg(
        F.count("*").alias("visitors"), F.count_if("is_bot").alias("bot_visitors")
    )


def stored_traffic(
    daily: DataFrame,
    grain: str,
    visitor_table: DataFrame | None = None,
    exact: DataFrame | None = None,
) -> DataFrame:
    """Month or year totals from the stored day table.

    Visitors are exact where the visitor table covers the period, or the period
    is among the ``exact`` figures (as ``period_visitors`` gives them). Else
    they fall back to the sum of the daily figures, which counts a returning
    visitor once a day.
    """
    key = GRAIN_COLUMNS[grain]
    sums = by_period(
        daily,
        grain,
        [],
        F.sum("hits").alias("hits"),
        F.sum("visitors").alias("summed_visitors"),
        F.sum("bot_hits").alias("bot_hits"),
        F.sum("bot_visitors").alias("summed_bot_visitors"),
    )
    if exact is None and visitor_table is not None:
        exact = period_visitors(visitor_table, grain)
    if exact is None:
        return sums.select(
            "domain",
            key,
            "hits",
            F.col("summed_visitors").alias("visitors"),
            "bot_hits",
            F.col("summed_bot_visitors").alias("bot_visitors"),
        )
    return sums.join(exact, ["domain", key], "left").select(
        "domain",
        key,
        "hits",
        F.coalesce("visitors", "summed_visitors").alias("visitors"),
        "bot_hits",
        F.coalesce("bot_visitors", "summed_bot_visitors").alias("bot_visitors"),
    )


# --- pages ------------------------------------------------------------------


def page_visits(requests: DataFrame) -> DataFrame:
    """One row per (site, day, path, address); each is one visitor of that day."""
    return (
        hits(requests)
        .groupBy("domain", "dt", "path", "c_ip")
        .agg(F.count("*").alias("hits"), F.count("bot_name").alias("bot_hits"))
        .withColumn("visitors", F.lit(1).cast("bigint"))
    )


def visitors_of_pages(visits: DataFrame) -> DataFrame:
    """One row per (site, day, address) from the page visits of the day."""
    return visits.groupBy("domain", "dt", "c_ip").agg(
        F.sum("hits").alias("hits"), F.sum("bot_hits").alias("bot_hits")
    )


def pages(page_rows: DataFrame, grain: str = "day") -> DataFrame:
    """Hits, visitors and bot hits per (site, period, category, path).

    ``page_rows`` are page visits or stored page days. Over a month or a year
    ``visitors`` is the sum of the daily visitors. From page visits that sum is
    a row count, so a month needs no daily table in between.
    """
    totals = by_period(
        page_rows,
        grain,
        ["path"],
        F.sum("hits").alias("hits"),
        F.sum("visitors").alias("visitors"),
        F.sum("bot_hits").alias("bot_hits"),
    )
    return totals.select(
        "domain",
        GRAIN_COLUMNS[grain],
        rq.path_category(F.col("path")).alias("category"),
        "path",
        "hits",
        "visitors",
        "bot_hits",
    )


def page_totals(page_rows: DataFrame) -> DataFrame:
    """Day totals added up from the pages: a visitor of two pages counts twice."""
    return page_rows.groupBy("domain", "dt").agg(
        F.sum("hits").alias("hits"),
        F.sum("visitors").alias("visitors"),
        F.sum("bot_hits").alias("bot_hits"),
    )


# --- hours, bots, crawler paths, referers -----------------------------------


def hourly(requests: DataFrame) -> DataFrame:
    """Hits and exact visitors per (site, day, hour); impossible hours are left out."""
    by_hour = hits(requests).withColumn("hour", rq.request_hour(F.col("time")))
    return (
        by_hour.where(F.col("hour") <= 23)
        .groupBy("domain", "dt", "hour", "c_ip")
        .agg(F.count("*").alias("hits"))
        .groupBy("domain", "dt", "hour")
        .agg(F.sum("hits").alias("hits"), F.count("*").alias("visitors"))
    )


def bot_requests(requests: DataFrame) -> DataFrame:
    """Requests made by bots: all of them, not only the hits."""
    return requests.where(F.col("bot_name").isNotNull()).select(
        "domain",
        "dt",
        "bot_name",
        F.lit(1).cast("bigint").alias("hits"),
        F.col("dt").alias("last_crawl"),
    )


def bots(bot_rows: DataFrame, grain: str = "day") -> DataFrame:
    """Requests and last day seen per (site, period, bot)."""
    return by_period(
        bot_rows,
        grain,
        ["bot_name"],
        F.sum("hits").alias("hits"),
        F.max("last_crawl").alias("last_crawl"),
    )


def crawler_hits(requests: DataFrame) -> DataFrame:
    """Hits of the search crawler."""
    return (
        hits(requests)
        .where("is_crawler")
        .select("domain", "dt", "path", F.lit(1).cast("bigint").alias("hits"))
    )


def crawled_paths(crawler_rows: DataFrame, grain: str = "day") -> DataFrame:
    """Search crawler hits per (site, period, path)."""
    return by_period(crawler_rows, grain, ["path"], F.sum("hits").alias("hits"))


def referred_hits(requests: DataFrame) -> DataFrame:
    """Hits that came from another host."""
    referer, domain = F.col("referer"), F.col("domain")
    return (
        hits(requests)
        .where(rq.is_external_referer(referer, domain))
        .select("domain", "dt", "referer", F.lit(1).cast("bigint").alias("hits"))
    )


def referers(referer_rows: DataFrame, grain: str = "day") -> DataFrame:
    """Hits per (site, period, full referer text)."""
    return by_period(referer_rows, grain, ["referer"], F.sum("hits").alias("hits"))
