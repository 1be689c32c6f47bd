"""The report tables of a day, a month and a year."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions import shares
from logtide.functions.calendars import GRAIN_COLUMNS, period_label
from logtide.operators import calendars, gaps, rankings, rollups
from logtide.operators.requests import QUALITY_COLUMNS, data_quality
from logtide.plans.tables import write_partitioned
from logtide.schema import (
    DAY_METRICS_SCHEMA,
    TOP_BOTS,
    TOP_BOTS_YEAR,
    TOP_GAPS,
    TOP_PAGES,
    TOP_REFERERS,
)

#: Report tables written at the same time.
PUBLISH_AT_ONCE = 6


def traffic_report(requests: DataFrame, days: DataFrame, grain: str = "day") -> DataFrame:
    """Hits, visitors and their bot parts for every site and period of a calendar."""
    return calendars.zero_filled(
        calendars.site_periods(days, grain) if grain != "day" else days,
        rollups.traffic(requests, grain),
    )


def traffic_series(traffic: DataFrame, grain: str) -> DataFrame:
    """The chart series of a report: hits and visitors per period."""
    return traffic.select("domain", GRAIN_COLUMNS[grain], "hits", "visitors")


def hourly_report(requests: DataFrame, days: DataFrame) -> DataFrame:
    """24 rows per site and day."""
    return calendars.zero_filled(calendars.site_hours(days), rollups.hourly(requests))


def daily_shares(daily: DataFrame) -> DataFrame:
    """Bar sizes of the days of a month."""
    month = F.trunc("dt", "month")
    return daily.withColumn("month", month).select(
        "domain",
        "dt",
        "hits",
        shares.share_of_max(F.col("hits"), "domain", "month").alias("share_of_max"),
    )


def hourly_shares(by_hour: DataFrame) -> DataFrame:
    """Bar sizes of the hours of a day."""
    return by_hour.select(
        "domain",
        "dt",
        "hour",
        "hits",
        shares.share_of_max(F.col("hits"), "domain", "dt").alias("share_of_max"),
    )


def monthly_shares(monthly: DataFrame) -> DataFrame:
    """Bar sizes of the months of a year."""
    return monthly.withColumn("year", F.substring("month", 1, 4)).select(
        "domain",
        "month",
        "hits",
        shares.share_of_max(F.col("hits"), "domain", "year").alias("share_of_max"),
    )


def _split(total: str, bots: str, prefix: str) -> list[Column]:
    return [
        shares.human_pct(F.col(total), F.col(bots)).alias(f"{prefix}_human_pct"),
        shares.bot_pct(F.col(total), F.col(bots)).alias(f"{prefix}_bot_pct"),
    ]


def kpis(traffic: DataFrame, bots: DataFrame, grain: str) -> DataFrame:
    """Headline figures of a month or year: totals, splits and number of active bots."""
    key = GRAIN_COLUMNS[grain]
    active = bots.groupBy("domain", key).agg(F.count("*").alias("active_bots"))
    return (
        traffic.join(active, ["domain", key], "left")
        .fillna(0, ["active_bots"])
        .select(
            "domain",
            key,
            "hits",
            *_split("hits", "bot_hits", "hits"),
            "visitors",
            *_split("visitors", "bot_visitors", "vis"),
            "active_bots",
        )
    )


def day_panel(page_rows: DataFrame, days: DataFrame) -> DataFrame:
    """Headline figures of a day, as its panel derives them from the page list.

    Visitors are added up over pages and bot visitors are an estimate; the
    exact figures are in the daily traffic report.
    """
    totals = calendars.zero_filled(days, rollups.page_totals(page_rows))
    estimate = shares.estimated_bot_visitors(F.col("visitors"), F.col("hits"), F.col("bot_hits"))
    return totals.withColumn("est_bot_visitors", estimate).select(
        "domain",
        "dt",
        "hits",
        "visitors",
        "bot_hits",
        "est_bot_visitors",
        *_split("hits", "bot_hits", "hits"),
        *_split("visitors", "est_bot_visitors", "vis"),
    )


def gap_report(requests: DataFrame, sitemap: DataFrame, days: DataFrame) -> DataFrame:
    """Sitemap entries without a crawler hit, for every month of the calendar."""
    crawled = rollups.crawled_paths(rollups.crawler_hits(requests), "month")
    return gaps.sitemap_gaps(sitemap, crawled, calendars.site_periods(days, "month"))


#: Metric of the day table -> what its ``name`` column holds.
DAY_METRICS = {
    "traffic": None,
    "hour": None,
    "page": "path",
    "bot": "bot_name",
    "crawled": "path",
    "referer": "referer",
    "quality": "check",
}


def day_metrics(
    requests: DataFrame,
    days: DataFrame,
    visits: DataFrame | None = None,
    log: DataFrame | None = None,
) -> DataFrame:
    """All day figures as one table, so that a day is one file and not seven.

    ``visits`` are the page visits of the requests, if they are stored already.
    With the ``log`` its data quality counts are kept as well.
    """
    visits = rollups.page_visits(requests) if visits is None else visits
    traffic = rollups.traffic_of(rollups.visitors_of_pages(visits))
    parts = {
        "traffic": calendars.zero_filled(days, traffic),
        "hour": hourly_report(requests, days),
        "page": rollups.pages(visits),
        "bot": rollups.bots(rollups.bot_requests(requests)),
        "crawled": rollups.crawled_paths(rollups.crawler_hits(requests)),
        "referer": rollups.referers(rollups.referred_hits(requests)),
    }
    if log is not None:
        counts = data_quality(log, ["domain", "dt"])
        parts["quality"] = counts.unpivot(["domain", "dt"], QUALITY_COLUMNS, "check", "hits").where(
            "hits > 0"
        )
    rows = []
    for metric, part in parts.items():
        part = part.withColumn("metric", F.lit(metric))
        if DAY_METRICS[metric]:
            part = part.withColumnRenamed(DAY_METRICS[metric], "name")
        rows.append(
            part.select(
                *[
                    (F.col(f.name) if f.name in part.columns else F.lit(None))
                    .cast(f.dataType)
                    .alias(f.name)
                    for f in DAY_METRICS_SCHEMA.fields
                ]
            )
        )
    return reduce(DataFrame.unionByName, rows)


def day_metric(table: DataFrame, metric: str) -> DataFrame:
    """The rows of one metric of the day table, in the columns of its report."""
    rows = table.where(F.col("metric") == metric)
    if DAY_METRICS[metric]:
        rows = rows.withColumnRenamed("name", DAY_METRICS[metric])
    return rows


def base_tables(table: DataFrame, visitor_table: DataFrame | None, grain: str) -> dict[str, DataFrame]:
    """Month or year rollups from the stored day table; the log is not read again."""
    return {
        f"{grain}_totals": rollups.stored_traffic(day_metric(table, "traffic"), grain, visitor_table),
        f"{grain}_pages": rollups.pages(day_metric(table, "page"), grain),
        f"{grain}_bots": rollups.bots(day_metric(table, "bot"), grain),
        f"{grain}_crawled_paths": rollups.crawled_paths(day_metric(table, "crawled"), grain),
        f"{grain}_referers": rollups.referers(day_metric(table, "referer"), grain),
    }


def year_tables(months: dict[str, DataFrame], visitor_table: DataFrame | None) -> dict[str, DataFrame]:
    """Year rollups from the rollups of its months; only visitors are counted anew."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    rows = {name: table.withColumn("dt", first) for name, table in months.items()}
    return {
        "year_totals": rollups.stored_traffic(rows["month_totals"], "year", visitor_table),
        "year_pages": rollups.pages(rows["month_pages"], "year"),
        "year_bots": rollups.bots(rows["month_bots"], "year"),
        "year_crawled_paths": rollups.crawled_paths(rows["month_crawled_paths"], "year"),
        "year_referers": rollups.referers(rows["month_referers"], "year"),
    }


def derived_tables(base: dict[str, DataFrame], grain: str) -> dict[str, DataFrame]:
    """Headline figures and ranked lists from the rollups of a period."""
    traffic, pages = base[f"{grain}_totals"], base[f"{grain}_pages"]
    bots, referers = base[f"{grain}_bots"], base[f"{grain}_referers"]
    top_bots = TOP_BOTS_YEAR if grain == "year" else TOP_BOTS
    return {
        f"{grain}_kpis": kpis(traffic, bots, grain),
        f"{grain}_top_pages": rankings.top_content_pages(pages, grain, TOP_PAGES),
        f"{grain}_static_assets": rankings.static_assets(pages, grain),
        f"{grain}_top_bots": rankings.top_by_hits(bots, grain, "bot_name", top_bots),
        f"{grain}_top_referers": rankings.top_by_hits(referers, grain, "referer", TOP_REFERERS),
    }


def period_tables(table: DataFrame, visitor_table: DataFrame | None, grain: str) -> dict[str, DataFrame]:
    """All month or year reports from the stored day table."""
    base = base_tables(table, visitor_table, grain)
    return base | derived_tables(base, grain)


def day_panels(table: DataFrame, days: DataFrame) -> dict[str, DataFrame]:
    """The reports of single days from the stored day table."""
    pages = rollups.pages(day_metric(table, "page"))
    by_hour = day_metric(table, "hour").select("domain", "dt", "hour", "hits", "visitors")
    daily = day_metric(table, "traffic").select(
        "domain", "dt", "hits", "visitors", "bot_hits", "bot_visitors"
    )
    return {
        "daily_traffic": daily,
        "daily_shares": daily_shares(daily),
        "day_panels": day_panel(pages, days),
        "day_hours": by_hour,
        "hourly_shares": hourly_shares(by_hour),
        "day_top_pages": rankings.top_content_pages(pages, "day", TOP_PAGES),
        "day_static_assets": rankings.static_assets(pages, "day"),
    }


def quality_table(
    table: DataFrame, days: DataFrame, tiny_files: DataFrame, bad_sitemaps: DataFrame
) -> DataFrame:
    """What a month's reports left out or handled by a default, per site and month.

    Besides the counts of rows: files passed over as too small, and 1 for a
    sitemap that is missing or can't be read. ``bad_sitemaps`` has a ``domain``
    column.
    """
    month = period_label(F.col("dt"), "month").alias("month")
    rows = day_metric(table, "quality").groupBy("domain", month).pivot("check", QUALITY_COLUMNS)
    files = tiny_files.groupBy("domain", month).agg(F.sum("files").alias("tiny_files"))
    broken = bad_sitemaps.select("domain", F.lit(1).cast("bigint").alias("unreadable_sitemaps"))
    return (
        calendars.site_periods(days, "month")
        .join(rows.agg(F.sum("hits")), ["domain", "month"], "left")
        .join(files, ["domain", "month"], "left")
        .join(broken.distinct(), "domain", "left")
        .fillna(0)
        .select("domain", "month", *QUALITY_COLUMNS, "tiny_files", "unreadable_sitemaps")
    )


def gap_tables(table: DataFrame, sitemap: DataFrame, days: DataFrame) -> dict[str, DataFrame]:
    """The gap reports from the stored crawler paths."""
    crawled = rollups.crawled_paths(day_metric(table, "crawled"), "month")
    missing = gaps.sitemap_gaps(sitemap, crawled, calendars.site_periods(days, "month"))
    return {
        "sitemap_gaps": missing,
        "sitemap_gap_summary": gaps.gap_summary(missing, TOP_GAPS),
    }


def period_key(report: DataFrame) -> str:
    """The column a published report is partitioned by, beside the site."""
    return "year" if "year" in report.columns else "month"


def _publish_one(report: DataFrame, path: str) -> None:
    key = period_key(report)
    if "dt" in report.columns:
        report = report.withColumn("month", period_label(F.col("dt"), "month"))
    order = [
        F.desc(c) if c == "hits" else F.asc(c)
        for c in ("month", "dt", "rank", "hour", "pos", "hits", "path", "bot_name", "referer")
        if c in report.columns and c != key
    ]
    write_partitioned(report, path, ["domain", key], order)


def publish(tables: dict[str, DataFrame], root: str) -> None:
    """Write each report as a table below ``root``, partitioned by site and period.

    Reports of single days go by month too, as a day of one would be a file of
    a few rows. Files are sorted the way the report lists its rows. Tables are
    small and independent, so several are written at a time.
    """
    with ThreadPoolExecutor(max_workers=PUBLISH_AT_ONCE) as pool:
        list(pool.map(lambda name: _publish_one(tables[name], f"{root}/{name}"), tables))


def read_published(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Published tables read back, in their columns."""
    return {
        name: spark.read.schema(table.schema).parquet(f"{root}/{name}").select(*table.columns)
        for name, table in tables.items()
    }


def available_years(year_table: DataFrame, current_year: Column, sites: DataFrame | None = None) -> DataFrame:
    """Years with a report per site, and the one being made, in order.

    The current year is listed for every site of ``sites``, or else for those
    that have a report already.
    """
    known = year_table.select("domain", F.col("year").cast("int").alias("year")).distinct()
    named = (known if sites is None else sites).select("domain").distinct()
    current = named.select("domain", current_year.cast("int").alias("year"))
    return known.union(current).distinct().orderBy("domain", "year")
