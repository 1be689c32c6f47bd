"""The registered queries, over the log derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.calendars import period_label
from logtide.operators import calendars, gaps, rankings, rollups
from logtide.operators import requests as req
from logtide.plans import compaction, jobs, refresh, reports, visitor_sets
from logtide.plans.state import read_state
from logtide.schema import (
    DAY_KEYS,
    TOP_BOTS,
    TOP_BOTS_YEAR,
    TOP_GAPS,
    TOP_PAGES,
    TOP_REFERERS,
)
from logtide.sources import commits
from logtide.sources.event_log import BOTS, SITES, access_log, sitemap
from logtide.sources.logs import LogSource, read_narrow
from logtide.sources.lookups import Site, bots_table, select_sites, sites_table
from logtide.sources.sitemaps import read_sitemaps, sitemap_problems
from logtide.sources.storage import fresh_folder, glob_files, mark

Query = Callable[[SparkSession, str], DataFrame]

#: A configured site that has no files, so that plans show days without data.
IDLE_SITE = "c.example.net"


class _Inputs:
    """The derived log and the calendar of the months it covers."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.log = access_log(spark, sf_dir)
        self.requests = req.classify(self.log, BOTS)

    @property
    def months(self) -> tuple[Column, Column]:
        return calendars.log_months(self.log)

    @property
    def days(self) -> DataFrame:
        return calendars.site_days(sites_table(self.spark, SITES), *self.months)

    def bounds(self) -> tuple[date, date]:
        """First and last day of the log."""
        row = self.log.agg(F.min("dt").alias("first"), F.max("dt").alias("last")).first()
        return row["first"], row["last"]

    def pages(self, grain: str) -> DataFrame:
        return rollups.pages(rollups.page_visits(self.requests), grain)

    def bots(self, grain: str) -> DataFrame:
        return rollups.bots(rollups.bot_requests(self.requests), grain)

    def crawled(self, grain: str) -> DataFrame:
        return rollups.crawled_paths(rollups.crawler_hits(self.requests), grain)

    def referers(self, grain: str) -> DataFrame:
        return rollups.referers(rollups.referred_hits(self.requests), grain)

    def traffic(self, grain: str) -> DataFrame:
        return reports.traffic_report(self.requests, self.days, grain)

    def gaps(self) -> DataFrame:
        pages = sitemap(self.spark, self.sf_dir)
        return reports.gap_report(self.requests, pages, self.days)


def _site_daily_traffic(i: _Inputs) -> DataFrame:
    site = select_sites(SITES, "a.example.com")
    days = calendars.site_days(sites_table(i.spark, site), *i.months)
    own = i.requests.where(F.col("domain") == site[0].domain)
    return reports.traffic_series(reports.traffic_report(own, days), "day")


def _unique_visitors_range(i: _Inputs) -> DataFrame:
    """A range inside the log, from the stored visitor table."""
    root = fresh_folder(i.spark, "range")
    refresh.write_visitors(rollups.visitor_days(i.requests), root)
    first, last = i.bounds()
    first, last = first + timedelta(days=5), last - timedelta(days=5)
    return rollups.range_visitors(refresh.read_visitors(i.spark, root, first, last), first, last)


def _visitor_sets(i: _Inputs) -> tuple[str, date, date]:
    """Bitmaps of all days, written in two runs, and the first and last day."""
    root = fresh_folder(i.spark, "visitor-sets")
    first, last = i.bounds()
    rows = rollups.visitor_days(i.requests)
    half = F.lit(first + (last - first) / 2)
    for part in (F.col("dt") <= half, F.col("dt") > half):
        visitor_sets.write_days(i.spark, root, rows.where(part))
    return root, first, last


def _bitmap_visitors_range(i: _Inputs) -> DataFrame:
    """The same range, from the bitmaps of its days."""
    root, first, last = _visitor_sets(i)
    first, last = first + timedelta(days=5), last - timedelta(days=5)
    return visitor_sets.range_visitors(visitor_sets.read_days(i.spark, root, first, last))


def _bitmap_year_totals(i: _Inputs) -> DataFrame:
    """Year totals with visitors from bitmaps: of days, of months, and of years from these."""
    root, _, _ = _visitor_sets(i)
    months = visitor_sets.merged(visitor_sets.read_days(i.spark, root), "month")
    months = months.withColumn("dt", F.to_date(F.concat("month", F.lit("-01"))))
    exact = visitor_sets.period_visitors(months, "year")
    return rollups.stored_traffic(i.traffic("day"), "year", exact=exact)


def _bot_dimension_long_list(i: _Inputs) -> DataFrame:
    """The bots and, after them, a pattern for every user of the log."""
    users = i.spark.read.parquet(f"{i.sf_dir}/events.parquet").where("user_id IS NOT NULL")
    more = users.select("user_id").distinct().selectExpr(
        "CAST(1000 + user_id AS INT) AS priority",
        "concat('Bot/', user_id, '.') AS pattern",
        "concat('Bot ', user_id) AS bot_name",
    )
    return req.bot_dimension(i.log, bots_table(i.spark, BOTS).unionByName(more))


def _calendar_days(i: _Inputs) -> DataFrame:
    first, last = i.months
    starts = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    months = i.spark.range(1).select(starts.alias("start"))
    return calendars.calendar_days(
        months.select(period_label(F.col("start"), "month").alias("month"))
    )


def _access_log_narrow(i: _Inputs) -> DataFrame:
    root = fresh_folder(i.spark, "narrow")
    refresh.write_narrow(i.log, root)
    return read_narrow(i.spark, f"{root}/{refresh.NARROW}")


def _visitor_days(i: _Inputs) -> DataFrame:
    root = fresh_folder(i.spark, "visitors")
    refresh.write_visitors(rollups.visitor_days(i.requests), root)
    return refresh.read_visitors(i.spark, root)


def _partly_synced(i: _Inputs, name: str) -> tuple[str, DataFrame, date, Column]:
    """A cache of the days up to a week before the last, and what a refresh takes."""
    root = fresh_folder(i.spark, name)
    first, last = i.bounds()
    earlier = i.log.where(F.col("dt") < last - timedelta(days=7))
    days = earlier.select(*DAY_KEYS).distinct()
    refresh.sync_log(i.spark, earlier, days, root, last)
    refresh.mark_done(i.spark, days, root)
    wanted = calendars.site_days(sites_table(i.spark, SITES), first, last)
    return root, wanted, last, F.col("dt") == first


def _sync_plan(i: _Inputs) -> DataFrame:
    """The log is cached up to a week before its last day, which is "today"."""
    root, _, last, forced = _partly_synced(i, "sync")
    wanted = calendars.site_days(sites_table(i.spark, SITES), *i.months, as_of=last)
    return refresh.sync_plan(wanted, read_state(i.spark, root), last, forced)


def _refreshed_log(i: _Inputs) -> DataFrame:
    """A log cached in part is whole again after the sync."""
    root, wanted, last, forced = _partly_synced(i, "synced")
    refresh.sync_log(i.spark, i.log, wanted, root, last, forced)
    return read_narrow(i.spark, f"{root}/{refresh.NARROW}")


def _stored_month_totals(i: _Inputs, root: str) -> DataFrame:
    """Month totals from the stored tables a refresh leaves behind."""
    table = refresh.read_day_metrics(i.spark, root)
    return reports.base_tables(table, refresh.read_visitors(i.spark, root), "month")["month_totals"]


def _refreshed_month_totals(i: _Inputs) -> DataFrame:
    root = fresh_folder(i.spark, "refreshed")
    first, last = i.bounds()
    earlier, wanted = last - timedelta(days=7), sites_table(i.spark, SITES)
    before = calendars.site_days(wanted, first, earlier)
    refresh.refresh(i.spark, i.log, before, root, BOTS, earlier + timedelta(days=1))
    days = calendars.site_days(wanted, first, last)
    refresh.refresh(i.spark, i.log, days, root, BOTS, last, F.col("dt") == first)
    return _stored_month_totals(i, root)


def _late_rows_month_totals(i: _Inputs) -> DataFrame:
    """Raw files: a day is read while it is written, and more of it lands afterwards."""
    root, raw = fresh_folder(i.spark, "late"), fresh_folder(i.spark, "raw")
    first, last = i.bounds()
    cut = last - timedelta(days=4)
    early = (F.col("dt") < cut) | ((F.col("dt") == cut) & (F.col("time") < "12:00:00"))
    sites = [Site(s.domain, f"{raw}/domain={s.domain}") for s in SITES]
    for rows, end, as_of in (
        (i.log.where(early), cut, cut),
        (i.log.where(~early), last, last + timedelta(days=1)),
    ):
        _land(rows, raw)
        source = LogSource(i.spark, sites, f"{root}/none", first, end)
        wanted = calendars.site_days(sites_table(i.spark, sites), first, end)
        refresh.refresh(
            i.spark, source.rows, wanted, root, BOTS, as_of, listing=source.listing()
        )
    return _stored_month_totals(i, root)


def _interrupted_refresh_totals(i: _Inputs) -> DataFrame:
    """A run on all days ends after the log was fetched; the next one makes up for it."""
    root = fresh_folder(i.spark, "interrupted")
    first, last = i.bounds()
    as_of = last + timedelta(days=1)
    wanted = calendars.site_days(sites_table(i.spark, SITES), first, last)
    half = i.log.where(F.col("time") < "12:00:00")
    refresh.refresh(i.spark, half, wanted, root, BOTS, as_of)
    refresh.sync_log(i.spark, i.log, wanted, root, as_of, F.lit(True))
    refresh.refresh(i.spark, i.log, wanted, root, BOTS, as_of)
    return _stored_month_totals(i, root)


def _land(log: DataFrame, root: str) -> None:
    """Add rows as raw delivery files, two folders a day."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    hour = F.when(F.col("time") < "12:00:00", "00").otherwise("12")
    keys = ["domain", *parts, "hour"]
    others = [c for c in log.columns if c not in DAY_KEYS]
    (
        log.withColumns({k: F.date_format("dt", v) for k, v in parts.items()})
        .withColumn("hour", hour)
        .hint("rebalance", *[F.col(k) for k in keys])
        .select(*keys, *others)
        .write.partitionBy(*keys)
        .mode("append")
        .parquet(root)
    )


def land_raw(i: _Inputs) -> list[Site]:
    """The log as raw delivery files of two sites, and a site without files.

    A column has another type at the second site, and one file is too small.
    """
    root = fresh_folder(i.spark, "raw")
    one, other = (F.col("domain") == SITES[0].domain), (F.col("domain") != SITES[0].domain)
    _land(i.log.where(one).withColumn("sc_bytes", F.length("cs_uri_stem").cast("bigint")), root)
    _land(i.log.where(other).withColumn("sc_bytes", F.lit("-")), root)
    _, last = i.bounds()
    day = f"year={last:%Y}/month={last:%m}/day={last:%d}/hour=12"
    mark(i.spark, f"{root}/domain={SITES[0].domain}/{day}/tiny.parquet", "PAR1")
    domains = [*[s.domain for s in SITES], IDLE_SITE]
    return [Site(d, f"{root}/domain={d}") for d in domains]


def _to_compact(i: _Inputs) -> tuple[list[Site], str]:
    """Raw files, and a table of the days up to a week before the last one."""
    table = fresh_folder(i.spark, "compact")
    _, last = i.bounds()
    done = i.log.where(F.col("dt") < last - timedelta(days=7))
    compaction.sort_and_write(done, table)
    return land_raw(i), table


def _compaction_plan(i: _Inputs) -> DataFrame:
    """Plan on the last day of the log, with the days up to a week before it done."""
    sites, table = _to_compact(i)
    first, last = i.bounds()
    plan = compaction.compaction_plan(i.spark, sites, table, first, last, as_of=last)
    return plan.select(*DAY_KEYS, "rows", "action")


def _compacted(i: _Inputs) -> str:
    table = fresh_folder(i.spark, "compact")
    first, last = i.bounds()
    after = last + timedelta(days=1)
    compaction.compact(i.spark, land_raw(i), table, first, last, as_of=after)
    return table


def _crashed_compaction_log(i: _Inputs) -> DataFrame:
    """A run ended with some files written and none committed; the next compacts all days."""
    table = fresh_folder(i.spark, "crashed")
    first, last = i.bounds()
    commits.begin(i.spark, table)
    compaction.write_days(i.log.where(F.col("time") < "12:00:00"), table)
    compaction.compact(i.spark, land_raw(i), table, first, last, as_of=last + timedelta(days=1))
    return read_narrow(i.spark, table)


def _compacted_day_order(i: _Inputs) -> DataFrame:
    """First and last key of every compacted day, and whether its files overlap."""
    return compaction.file_order(i.spark, _compacted(i)).drop("files")


def _compaction_summary(i: _Inputs) -> DataFrame:
    sites, table = _to_compact(i)
    first, last = i.bounds()
    summary = compaction.compact(i.spark, sites, table, first, last, as_of=last)
    return summary.select(*DAY_KEYS, "rows", "skipped")


def _compaction_totals(i: _Inputs) -> DataFrame:
    """What a compaction run did, per site."""
    sites, table = _to_compact(i)
    first, last = i.bounds()
    summary = compaction.compact(i.spark, sites, table, first, last, as_of=last)
    columns = ("domain", "compacted_days", "skipped_days", "rows")
    return compaction.run_totals(summary).select(*columns)


def report_job(i: _Inputs, sites: list[Site], root: str, days_after: int = 1) -> str:
    """The report job some days after the log's last, for its last year; where it publishes."""
    _, last = i.bounds()
    jobs.report(
        i.spark, sites, BOTS, f"{root}/none", f"{root}/cache", f"{root}/out",
        year=str(last.year), as_of=last + timedelta(days=days_after),
    )
    return f"{root}/out"


def _one_day_changed_reports(i: _Inputs) -> DataFrame:
    """Month and year figures after half a day of one site came late.

    The second run writes that month and year of that site and leaves the rest.
    """
    root, raw = fresh_folder(i.spark, "changed"), fresh_folder(i.spark, "raw")
    _, last = i.bounds()
    is_late = (F.col("domain") == SITES[0].domain) & (F.col("time") >= "12:00:00")
    is_late = is_late & (F.col("dt") == last - timedelta(days=10))
    sites = [Site(s.domain, f"{raw}/domain={s.domain}") for s in SITES]
    _land(i.log.where(~is_late), raw)
    report_job(i, sites, root)
    _land(i.log.where(is_late), raw)
    out = report_job(i, sites, root, days_after=2)
    names = ["hits", "visitors", "bot_hits", "bot_visitors"]
    rows = []
    for grain in ("month", "year"):
        table = i.spark.read.parquet(f"{out}/{grain}_totals")
        period = F.col(grain).cast("string").alias("period")
        rows.append(
            table.select("domain", period, *names)
            .unpivot(["domain", "period"], names, "name", "value")
            .withColumn("report", F.lit(f"{grain}_totals"))
        )
    pages = i.spark.read.parquet(f"{out}/year_pages")
    rows.append(
        pages.select(
            "domain", F.col("year").cast("string").alias("period"), F.col("path").alias("name"),
            F.col("visitors").alias("value"), F.lit("year_pages").alias("report"),
        )
    )
    return reduce(DataFrame.unionByName, rows)


def _published_reports(i: _Inputs) -> DataFrame:
    """Figures of the published tables no other query reads, one per row."""
    root = fresh_folder(i.spark, "report")
    own = {s.domain for s in SITES}
    out = report_job(i, [s for s in land_raw(i) if s.domain in own], root)
    figures = {
        "daily_traffic": ("dt", ["hits", "visitors"]),
        "daily_shares": ("dt", ["share_of_max"]),
        "month_shares": ("month", ["share_of_max"]),
        "years": ("year", ["is_current"]),
        "data_quality": ("month", [*req.QUALITY_COLUMNS, "tiny_files"]),
    }

    def figure(report: str, period: Column, name: Column, value: Column) -> list[Column]:
        return [
            F.lit(report).alias("report"),
            "domain",
            period.cast("string").alias("period"),
            name.cast("string").alias("name"),
            value.cast("double").alias("value"),
        ]

    hours = i.spark.read.parquet(f"{out}/hourly_shares")
    rows = [hours.select(*figure("hourly_shares", F.col("dt"), F.col("hour"), F.col("share_of_max")))]
    for report, (period, names) in figures.items():
        table = i.spark.read.parquet(f"{out}/{report}")
        rows += [table.select(*figure(report, F.col(period), F.lit(n), F.col(n))) for n in names]
    return reduce(DataFrame.unionByName, rows)


def _sitemap_entries(i: _Inputs) -> DataFrame:
    """The page URLs written as sitemap files, and read back in one scan."""
    folder = fresh_folder(i.spark, "sitemaps")
    urls = i.spark.read.parquet(f"{i.sf_dir}/pages.parquet").select(F.col("url").alias("loc"))
    writer = urls.write.format("xml").option("rootTag", "urlset").option("rowTag", "url")
    writer.save(folder)
    files = [f for f in glob_files(i.spark, f"{folder}/part-*")]
    sites = [Site(f"s{n}.example.com", None, file) for n, file in enumerate(files)]
    return read_sitemaps(i.spark, sites).select("loc")


def _sitemap_problems(i: _Inputs) -> DataFrame:
    """The page URLs as sitemap files, whole and spoilt, and what is read of each kind."""
    folder = fresh_folder(i.spark, "whole")
    urls = i.spark.read.parquet(f"{i.sf_dir}/pages.parquet").select(F.col("url").alias("loc"))
    urls.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(folder)
    text = F.col("value")
    kinds = {
        "good": text,
        "cut": F.substring(text, F.lit(1), F.length(text) - 12),
        "gone": F.lit("<html>gone</html>"),
        "bare": F.regexp_replace(text, "<loc>[^<]*</loc>", "<x/>"),
        "blank": F.lit(" "),
    }
    spoilt = fresh_folder(i.spark, "spoilt")
    whole = i.spark.read.text(f"{folder}/part-*", wholetext=True)
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]))
    whole.select(kind.alias("of")).select("of.*").write.partitionBy("kind").text(spoilt)
    sites = [
        Site(f"{k}.example.com", None, file) for k in kinds for file in glob_files(i.spark, f"{spoilt}/kind={k}/part-*")
    ]
    sites.append(Site("missing.example.com", None, f"{spoilt}/none.xml"))
    entries = read_sitemaps(i.spark, sites).groupBy("domain").agg(F.count("*").alias("entries"))
    domains = sites_table(i.spark, sites).select("domain").distinct()
    return (
        domains.join(sitemap_problems(i.spark, sites).distinct(), "domain", "left")
        .join(entries, "domain", "left")
        .select("domain", F.coalesce("problem", F.lit("none")).alias("problem"), F.coalesce("entries", F.lit(0)).alias("entries"))
    )


def _available_years(i: _Inputs) -> DataFrame:
    root = fresh_folder(i.spark, "years")
    reports.publish({"year_totals": rollups.traffic(i.requests, "year")}, root)
    table = i.spark.read.parquet(f"{root}/year_totals")
    next_year = i.log.agg(F.max(F.year("dt")) + 1).scalar()
    return reports.available_years(table, next_year)


_QUERIES: dict[str, Callable[[_Inputs], DataFrame]] = {
    # log, classification, lookups
    "access_log_narrow": _access_log_narrow,
    "classified_requests": lambda i: req.classified_counts(i.requests),
    "bot_dimension": lambda i: req.bot_dimension(i.log, bots_table(i.spark, BOTS)),
    "bot_dimension_long_list": _bot_dimension_long_list,
    "data_quality": lambda i: req.data_quality(i.log),
    "calendar_days": _calendar_days,
    # days
    "daily_traffic": lambda i: i.traffic("day").orderBy("domain", "dt"),
    "site_daily_traffic": _site_daily_traffic,
    "daily_traffic_share": lambda i: reports.daily_shares(i.traffic("day")),
    "hourly_traffic": lambda i: reports.hourly_report(i.requests, i.days),
    "hourly_traffic_share": lambda i: reports.hourly_shares(
        reports.hourly_report(i.requests, i.days)
    ),
    "page_stats": lambda i: i.pages("day"),
    "bot_activity_daily": lambda i: i.bots("day").drop("last_crawl"),
    "google_hits": lambda i: i.crawled("day"),
    "referers_daily": lambda i: i.referers("day"),
    "day_panel": lambda i: reports.day_panel(rollups.page_visits(i.requests), i.days),
    # visitors
    "visitor_days": _visitor_days,
    "unique_visitors_range": _unique_visitors_range,
    "bitmap_visitors_range": _bitmap_visitors_range,
    "bitmap_year_totals": _bitmap_year_totals,
    # months and years
    "month_totals": lambda i: i.traffic("month"),
    "year_totals": lambda i: i.traffic("year"),
    "monthly_traffic": lambda i: reports.traffic_series(i.traffic("month"), "month"),
    "monthly_traffic_share": lambda i: reports.monthly_shares(i.traffic("month")),
    "month_pages": lambda i: i.pages("month"),
    "year_pages": lambda i: i.pages("year"),
    "month_bots": lambda i: i.bots("month"),
    "year_bots": lambda i: i.bots("year"),
    "month_google_hits": lambda i: i.crawled("month"),
    "year_google_hits": lambda i: i.crawled("year"),
    "month_referers": lambda i: i.referers("month"),
    "year_referers": lambda i: i.referers("year"),
    "month_kpis": lambda i: reports.kpis(i.traffic("month"), i.bots("month"), "month"),
    "year_kpis": lambda i: reports.kpis(i.traffic("year"), i.bots("year"), "year"),
    # ranked lists
    "top_content_pages": lambda i: rankings.top_content_pages(
        i.pages("month"), "month", TOP_PAGES
    ),
    "day_top_content_pages": lambda i: rankings.top_content_pages(
        i.pages("day"), "day", TOP_PAGES
    ),
    "year_top_content_pages": lambda i: rankings.top_content_pages(
        i.pages("year"), "year", TOP_PAGES
    ),
    "static_assets": lambda i: rankings.static_assets(i.pages("month"), "month"),
    "day_static_assets": lambda i: rankings.static_assets(i.pages("day"), "day"),
    "year_static_assets": lambda i: rankings.static_assets(i.pages("year"), "year"),
    "top_bots": lambda i: rankings.top_by_hits(
        i.bots("month"), "month", "bot_name", TOP_BOTS
    ).select("domain", "month", "rank", "bot_name", "hits"),
    "day_top_bots": lambda i: rankings.top_by_hits(
        i.bots("day"), "day", "bot_name", TOP_BOTS
    ).select("domain", "dt", "rank", "bot_name", "hits"),
    "year_top_bots": lambda i: rankings.top_by_hits(
        i.bots("year"), "year", "bot_name", TOP_BOTS_YEAR
    ).select("domain", "year", "rank", "bot_name", "hits"),
    "top_referers": lambda i: rankings.top_by_hits(
        i.referers("month"), "month", "referer", TOP_REFERERS
    ),
    "year_top_referers": lambda i: rankings.top_by_hits(
        i.referers("year"), "year", "referer", TOP_REFERERS
    ),
    # crawl gaps
    "sitemap_gaps": lambda i: i.gaps(),
    "sitemap_gap_summary": lambda i: gaps.gap_summary(i.gaps(), TOP_GAPS),
    # table maintenance
    "sync_plan": _sync_plan,
    "refreshed_log": _refreshed_log,
    "refreshed_month_totals": _refreshed_month_totals,
    "compaction_plan": _compaction_plan,
    "late_rows_month_totals": _late_rows_month_totals,
    "interrupted_refresh_totals": _interrupted_refresh_totals,
    "compacted_log": lambda i: read_narrow(i.spark, _compacted(i)),
    "crashed_compaction_log": _crashed_compaction_log,
    "compacted_day_order": _compacted_day_order,
    "compaction_totals": _compaction_totals,
    "published_reports": _published_reports,
    "one_day_changed_reports": _one_day_changed_reports,
    "sitemap_entries": _sitemap_entries,
    "sitemap_problems": _sitemap_problems,
    "compaction_summary": _compaction_summary,
    "available_years": _available_years,
}


def _bind(build: Callable[[_Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_Inputs(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: _bind(build) for name, build in _QUERIES.items()}
