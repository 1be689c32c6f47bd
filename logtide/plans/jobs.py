"""The two jobs a user runs: publish reports, compact raw files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.calendars import month_range, year_range
from logtide.functions.requests import BotMap
from logtide.operators.calendars import site_days
from logtide.plans import compaction, periods, refresh, reports
from logtide.plans.state import read_state
from logtide.schema import DAY_KEYS, DAY_METRICS_SCHEMA
from logtide.sources.logs import LogSource, compact_path
from logtide.sources.lookups import Site, local_table, select_sites, sites_table
from logtide.sources.sitemaps import read_sitemaps, unreadable_sitemaps
from logtide.sources.storage import (
    drop_partitions,
    file_stamp,
    glob_files,
    partition_name,
    path_exists,
    removed_scratch,
    settled,
)


def _ranges(month: str | None, year: str | None) -> list[tuple[date, date, str | None]]:
    """The periods asked for, with the year if one is a whole year."""
    if month is None and year is None:
        raise ValueError("a month or a year is required")
    found = []
    if month is not None:
        found.append((*month_range(month), None))
    if year is not None:
        first, last = year_range(year)
        # A month of that year is among its months.
        found = [r for r in found if not first <= r[0] <= last]
        found.append((first, last, str(first.year)))
    return found


def _today(as_of: date | None) -> date:
    return as_of or datetime.now(UTC).date()


def _republish(
    spark: SparkSession, tables: dict[str, DataFrame], out: str, keys: Iterable[tuple[str, str]]
) -> None:
    """Publish reports in place of the earlier ones of the same sites and periods.

    Partitions are replaced one by one as they are written. Those of an earlier
    run that have no rows any more are deleted afterwards, so that a run that
    fails leaves readers what they had.
    """
    by_site: dict[str, list[str]] = {}
    for domain, label in keys:
        by_site.setdefault(domain, []).append(label)

    def files() -> list[str]:
        patterns = [
            f"{out}/{name}/domain={partition_name(spark, domain)}"
            f"/{reports.period_key(table)}={{{','.join(sorted(labels))}}}/*"
            for name, table in tables.items()
            for domain, labels in by_site.items()
        ]
        with ThreadPoolExecutor(max_workers=16) as pool:
            return [file for found in pool.map(lambda p: glob_files(spark, p), patterns) for file in found]

    before = set(files())
    reports.publish(tables, out)
    # A partition that was replaced has other files than before.
    leftover = {file.rsplit("/", 1)[0] for file in files() if file in before}
    drop_partitions(spark, leftover)


def _site_facts(spark: SparkSession, sites: Sequence[Site], bots: BotMap | DataFrame) -> DataFrame:
    """``(domain, facts)``: what a site's reports depend on beside its days."""
    patterns = [tuple(r) for r in bots.collect()] if isinstance(bots, DataFrame) else list(bots)
    with ThreadPoolExecutor(max_workers=16) as pool:
        stamps = list(pool.map(lambda s: file_stamp(spark, s.sitemap) if s.sitemap else None, sites))
    facts = [json.dumps([s.sitemap, stamp, patterns]) for s, stamp in zip(sites, stamps, strict=True)]
    return local_table(
        spark, {"domain": ([s.domain for s in sites], pa.string()), "facts": (facts, pa.string())}
    )


def _publish_months(
    spark: SparkSession,
    source: LogSource,
    sites: Sequence[Site],
    root: str,
    out: str,
    keys: set[tuple[str, str]],
) -> None:
    """Write the reports of some months of some sites, from the days of just these."""
    sites = [s for s in sites if s.domain in {domain for domain, _ in keys}]
    months = periods.keys_table(spark, keys, "month")
    first = max(source.first, month_range(min(label for _, label in keys))[0])
    last = min(source.last, month_range(max(label for _, label in keys))[1])
    days = site_days(sites_table(spark, sites), first, last)
    days = days.withColumn("month", F.date_format("dt", "yyyy-MM"))
    days = settled(spark, days.join(months, ["domain", "month"], "left_semi").select(*DAY_KEYS), "dirty-days")
    figures = periods.of_months(refresh.read_day_metrics(spark, root, first, last), days)
    visitors = periods.of_months(refresh.read_visitors(spark, root, first, last), days)

    base = reports.base_tables(figures, visitors, "month")
    tables = {**reports.day_panels(figures, days), **base}
    if any(s.sitemap for s in sites):
        tables |= reports.gap_tables(figures, read_sitemaps(spark, sites), days)
    broken = unreadable_sitemaps(spark, sites)
    tables["data_quality"] = reports.quality_table(figures, days, source.tiny_files(), broken)
    _republish(spark, tables, out, keys)
    # Lists and headline figures come from the rollups just written.
    stored = reports.read_published(spark, base, out)
    own = {n: t.join(F.broadcast(months), ["domain", "month"], "left_semi") for n, t in stored.items()}
    _republish(spark, reports.derived_tables(own, "month"), out, keys)


def _publish_month_shares(spark: SparkSession, out: str, keys: set[tuple[str, str]]) -> None:
    """The bars of the months of a year, for the years some months are in."""
    years = {(domain, label[:4]) for domain, label in keys}
    totals = spark.read.parquet(f"{out}/month_totals").select(
        F.col("domain").cast("string"), F.col("month").cast("string"), "hits"
    )
    totals = totals.withColumn("year", F.substring("month", 1, 4))
    own = totals.join(F.broadcast(periods.keys_table(spark, years, "year")), ["domain", "year"], "left_semi")
    shares = reports.monthly_shares(own).withColumn("year", F.substring("month", 1, 4).cast("int"))
    _republish(spark, {"month_shares": shares}, out, years)


def _publish_years(
    spark: SparkSession, sites: Sequence[Site], root: str, out: str, keys: set[tuple[str, str]], year: str
) -> None:
    """Write the reports of a year of some sites, from its months as published."""
    sites = [s for s in sites if (s.domain, year) in keys]
    of_sites = F.col("domain").isin([s.domain for s in sites])
    first, last = year_range(year)
    names = ["month_totals", "month_pages", "month_bots", "month_crawled_paths", "month_referers"]
    empty = spark.createDataFrame([], DAY_METRICS_SCHEMA)
    schemas = reports.base_tables(empty, None, "month")
    months = reports.read_published(spark, {n: schemas[n] for n in names if path_exists(spark, f"{out}/{n}")}, out)
    months = {n: months.get(n, schemas[n]) for n in names}
    months = {n: t.where(of_sites & F.col("month").startswith(f"{year}-")) for n, t in months.items()}
    visitors = refresh.read_visitors(spark, root, first, last).where(of_sites)
    yearly = reports.year_tables(months, visitors)
    _republish(spark, yearly, out, keys)
    stored = reports.read_published(spark, yearly, out)
    this = {n: t.where(of_sites & (F.col("year") == int(year))) for n, t in stored.items()}
    derived = reports.derived_tables(this, "year")
    known = spark.read.schema(yearly["year_totals"].schema).parquet(f"{out}/year_totals")
    years = reports.available_years(known.where(of_sites), F.lit(int(year)), sites_table(spark, sites))
    derived["years"] = years.withColumn("is_current", F.col("year") == int(year))
    _republish(spark, derived, out, keys)


def publish_changes(
    spark: SparkSession,
    source: LogSource,
    sites: Sequence[Site],
    bots: BotMap | DataFrame,
    root: str,
    out: str,
    year: str | None = None,
) -> periods.Dirty:
    """Publish the months of a range, and a year if given, that changed; returns which these are.

    What changed is decided by stamps alone (``plans.periods``). They are stored
    once all tables are written, so a run that ends early is made up for.
    """
    days = site_days(sites_table(spark, sites), source.first, source.last)
    stamps = periods.month_stamps(
        days, read_state(spark, root), source.tiny_files(), _site_facts(spark, sites, bots)
    )
    if year is not None:
        stamps = stamps.unionByName(periods.year_stamps(stamps, year))
    stamps = settled(spark, stamps, "stamps")
    dirty = periods.dirty_periods(stamps, periods.read_stamps(spark, root), out)
    if dirty.months:
        _publish_months(spark, source, sites, root, out, dirty.months)
        _publish_month_shares(spark, out, dirty.months)
    if dirty.years:
        _publish_years(spark, sites, root, out, dirty.years, year)
    if dirty:
        periods.write_stamps(spark, root, stamps, out)
    return dirty


def report(
    spark: SparkSession,
    sites: Sequence[Site],
    bots: BotMap | DataFrame,
    table: str,
    root: str,
    out: str,
    month: str | None = None,
    year: str | None = None,
    site: str | None = None,
    no_cache: bool = False,
    as_of: date | None = None,
) -> None:
    """Publish the reports of a month, of a year and all its months, or of both.

    ``table`` is the compacted log; days not compacted yet are read from the
    sites' raw files. ``root`` keeps the extract, the day figures and the state
    of every day between runs, so that only days are read again whose files
    changed or that were not over; ``no_cache`` reads all days again. ``out``
    receives one table per report. ``as_of`` stands for today. Only the months
    and years of sites that changed since they were published are written, a
    year from its months, so a run that finds nothing changed writes nothing.
    """
    chosen, today = select_sites(sites, site), _today(as_of)
    for first, last, whole_year in _ranges(month, year):
        last = min(last, today)
        if first > last:
            continue
        with removed_scratch(spark):
            source = LogSource(spark, chosen, table, first, last)
            days = site_days(sites_table(spark, chosen), first, last)
            forced = F.lit(True) if no_cache else None
            refresh.refresh(
                spark, source.rows, days, root, bots, today, forced, source.listing()
            )
            publish_changes(spark, source, chosen, bots, root, out, whole_year)


def compact(
    spark: SparkSession,
    sites: Sequence[Site],
    table: str | None = None,
    month: str | None = None,
    year: str | None = None,
    site: str | None = None,
    dry_run: bool = False,
    force: bool = False,
    as_of: date | None = None,
) -> DataFrame:
    """Compact a month or year; the result is the summary, or the plan in a dry run.

    Without a ``table``, each site is compacted into the ``compact`` folder next
    to its raw log. ``compaction.run_totals`` adds a summary up by site.
    """
    chosen, today = select_sites(sites, site), _today(as_of)
    run = compaction.compaction_plan if dry_run else compaction.compact
    if table is not None:
        targets = [(chosen, table)]
    else:
        targets = [([s], compact_path(s.log_path)) for s in chosen if s.log_path]
    found = [
        run(spark, own, target, first, last, as_of=today, force=force)
        for first, last, _ in _ranges(month, year)
        for own, target in targets
    ]
    return reduce(DataFrame.unionByName, found)
