"""Incremental refresh: recompute only the days that changed.

Three stored levels build on each other: the narrow log extract, the visitor
rows with the day figures, and the published month and year reports. A state
table tells for every day which files it was made from and when.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.calendars import DateLike, date_column
from logtide.functions.requests import BotMap
from logtide.operators import rollups
from logtide.operators.requests import classify
from logtide.plans.reports import day_metrics
from logtide.plans.state import read_state, state_version, write_changes
from logtide.plans.tables import write_partitioned
from logtide.schema import (
    COMPACT_SORT_KEYS,
    DAY_KEYS,
    DAY_METRICS_SCHEMA,
    NARROW_COLUMNS,
    VISITOR_SCHEMA,
)
from logtide.sources.commits import partition_days
from logtide.sources.logs import day_partitions, read_narrow
from logtide.sources.storage import (
    broadcast_if_small,
    drop_partitions,
    glob_folders,
    partition_name,
    settled,
)

NARROW = "narrow_log"
VISITORS = "visitors"
METRICS = "day_metrics"

#: What a listing tells of a day, in the state's columns.
_SOURCE = ["source", "files", "bytes", "newest"]

#: The log, or how to read the days of a plan.
Log = DataFrame | Callable[[set[tuple[str, date]]], DataFrame]


def sync_plan(
    wanted: DataFrame,
    state: DataFrame,
    as_of: DateLike,
    forced: Column | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """``(domain, dt, reason)`` of the days to fetch.

    A day is fetched when it is the one still being written (``today``), when
    the caller asks for it (``forced``), when it was never fetched (``new``),
    when a run on it did not end (``pending``), when it was fetched before it
    was over (``part_day``), or when the files it is made from are not those it
    was made from (``changed``). The last needs a ``listing`` with the source,
    files, bytes and newest change of each day.
    """
    known = state.select(
        *DAY_KEYS, "synced_on", "pending", *[F.col(c).alias(f"old_{c}") for c in _SOURCE]
    ).withColumn("known", F.lit(True))
    days = wanted.select(*DAY_KEYS).join(known, DAY_KEYS, "left")
    changed = F.lit(False)
    if listing is not None:
        days = days.join(listing.select(*DAY_KEYS, *_SOURCE), DAY_KEYS, "left")
        for column in _SOURCE:
            changed = changed | ~F.col(column).eqNullSafe(F.col(f"old_{column}"))
    reason = F.when(F.col("dt") == date_column(as_of), "today")
    if forced is not None:
        reason = reason.when(forced, "forced")
    reason = (
        reason.when(F.col("known").isNull(), "new")
        .when(F.col("pending"), "pending")
        .when(F.col("synced_on") <= F.col("dt"), "part_day")
        .when(changed, "changed")
    )
    return days.select(*DAY_KEYS, reason.alias("reason")).where(F.col("reason").isNotNull())


def write_narrow(log: DataFrame, root: str) -> None:
    """Store the report columns of a log, one folder per site and day."""
    narrow = log.select(*DAY_KEYS, *NARROW_COLUMNS)
    order = [c for c in COMPACT_SORT_KEYS if c in NARROW_COLUMNS]
    write_partitioned(narrow, f"{root}/{NARROW}", DAY_KEYS, order)


def write_visitors(visitors: DataFrame, root: str) -> None:
    """Store visitor rows (``rollups.visitor_days``), one folder per site and day."""
    rows = visitors.select(F.col("dt").cast("string").alias("date"), "c_ip", "is_bot", *DAY_KEYS)
    write_partitioned(rows, f"{root}/{VISITORS}", DAY_KEYS, ["c_ip"])


def read_visitors(
    spark: SparkSession, root: str, first: DateLike | None = None, last: DateLike | None = None
) -> DataFrame:
    """Visitor rows of a day range; other days are not listed into the scan."""
    table = f"{root}/{VISITORS}"
    if not glob_folders(spark, f"{table}/domain=*"):
        empty = spark.createDataFrame([], VISITOR_SCHEMA)
        return empty.select(*DAY_KEYS, "c_ip", "is_bot")
    rows = spark.read.schema(VISITOR_SCHEMA).parquet(table)
    return day_partitions(rows, first, last).select(*DAY_KEYS, "c_ip", "is_bot")


def _drop(spark: SparkSession, table: str, days: set[tuple[str, date]]) -> None:
    """Delete the folders of days, those that exist, under the names Spark gave them."""
    names = {f"domain={partition_name(spark, d)}/dt={dt}" for d, dt in days}
    patterns = {f"{table}/{name.split('/')[0]}/dt=*" for name in names}
    folders = [folder for pattern in patterns for folder in glob_folders(spark, pattern)]
    drop_partitions(spark, [f for f in folders if "/".join(f.split("/")[-2:]) in names])


def _keys(days: DataFrame) -> set[tuple[str, date]]:
    """The keys of a plan: (sites x days) at most."""
    return {(r["domain"], r["dt"]) for r in days.select(*DAY_KEYS).collect()}


def _held_days(spark: SparkSession, table: str, days: DataFrame) -> DataFrame:
    """``(domain, dt)`` a table holds, of the sites and range of these days."""
    span = days.agg(
        F.min("dt").alias("first"), F.max("dt").alias("last"), F.collect_set("domain").alias("domains")
    ).first()
    return partition_days(spark, table, span["domains"] or None, span["first"], span["last"])


def _pending_rows(
    state: DataFrame, days: DataFrame, listing: DataFrame | None, as_of: DateLike, number: int
) -> DataFrame:
    """Rows of these days for the state: pending, made from the files of the listing.

    A day that is read again only because it is, or was, not over keeps its
    revision if its files are those it was made from; any other gets ``number``.
    """
    fresh = days.select(*DAY_KEYS, *[c for c in ["reason"] if c in days.columns])
    if listing is not None:
        fresh = fresh.join(listing.select(*DAY_KEYS, *_SOURCE), DAY_KEYS, "left")
    types = {f.name: f.dataType for f in state.schema.fields}
    fresh = fresh.withColumns({c: F.lit(None).cast(types[c]) for c in _SOURCE if c not in fresh.columns})
    same = F.lit(False)
    if listing is not None and "reason" in fresh.columns:
        same = F.col("reason").isin("today", "part_day") & ~F.col("was_pending")
        for column in _SOURCE:
            same = same & F.col(column).eqNullSafe(F.col(f"old_{column}"))
    before = state.select(
        *DAY_KEYS,
        F.col("revision").alias("old_revision"),
        F.col("pending").alias("was_pending"),
        *[F.col(c).alias(f"old_{c}") for c in _SOURCE],
    )
    fresh = fresh.join(before, DAY_KEYS, "left").withColumns(
        {
            "synced_on": date_column(as_of),
            "has_visitors": F.lit(False),
            "pending": F.lit(True),
            "revision": F.when(same, F.col("old_revision")).otherwise(F.lit(number).cast("long")),
        }
    )
    return fresh.select(*state.columns)


def mark_pending(
    spark: SparkSession,
    days: DataFrame,
    root: str,
    as_of: DateLike,
    listing: DataFrame | None = None,
) -> None:
    """Note that a run on these days has begun; until it ends they are planned again."""
    number = state_version(spark, root) + 1
    write_changes(spark, root, _pending_rows(read_state(spark, root), days, listing, as_of, number))


def mark_done(spark: SparkSession, days: DataFrame, root: str) -> None:
    """Note that the run on these days has ended."""
    visited = _held_days(spark, f"{root}/{VISITORS}", days).withColumn("visited", F.lit(True))
    done = (
        read_state(spark, root)
        .join(days.select(*DAY_KEYS), DAY_KEYS, "left_semi")
        .join(visited, DAY_KEYS, "left")
        .withColumn("pending", F.lit(False))
        .withColumn("has_visitors", F.col("visited").isNotNull())
    )
    write_changes(spark, root, done)


def _planned_rows(log: Log, plan: DataFrame, days: set[tuple[str, date]]) -> DataFrame:
    rows = log(days) if callable(log) else log
    return rows.join(broadcast_if_small(plan.select(*DAY_KEYS)), DAY_KEYS, "left_semi")


def sync_log(
    spark: SparkSession,
    log: Log,
    wanted: DataFrame,
    root: str,
    as_of: DateLike,
    forced: Column | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Fetch the planned days of the log into the narrow extract; returns the plan.

    The days are marked pending before the extract is touched. A day that is
    fetched again is deleted first, so one that comes back empty does not keep
    old rows.
    """
    state = read_state(spark, root)
    plan = settled(spark, sync_plan(wanted, state, as_of, forced, listing), "sync-plan")
    days = _keys(plan)
    if days:
        mark_pending(spark, plan, root, as_of, listing)
        _drop(spark, f"{root}/{NARROW}", days)
        write_narrow(_planned_rows(log, plan, days), root)
    return plan


def lost_days(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """Days whose visitor rows are gone though the state has them."""
    state = read_state(spark, root).where(F.col("has_visitors") & ~F.col("pending"))
    held = _held_days(spark, f"{root}/{VISITORS}", wanted)
    return wanted.join(state, DAY_KEYS, "left_semi").join(held, DAY_KEYS, "left_anti").select(*DAY_KEYS)


def rebuild_tables(
    spark: SparkSession, wanted: DataFrame, plan: DataFrame, root: str, bots: BotMap | DataFrame
) -> DataFrame:
    """Rebuild the visitor rows and day figures of the synced days; returns those days.

    Days whose visitor rows were lost are rebuilt as well. The days are pending
    until all their tables are written.
    """
    stale = lost_days(spark, wanted, root).union(plan.select(*DAY_KEYS)).distinct()
    stale = settled(spark, stale, "stale-days")
    days = _keys(stale)
    if not days:
        return stale
    own = broadcast_if_small(stale)
    first, last = min(dt for _, dt in days), max(dt for _, dt in days)
    domains = sorted({domain for domain, _ in days})
    narrow = read_narrow(spark, f"{root}/{NARROW}", first, last, domains)
    log = narrow.join(own, DAY_KEYS, "left_semi")
    requests = classify(log, bots)
    # The one rollup by address; totals, pages and visitors come from it.
    visits = settled(spark, rollups.page_visits(requests), "page-visits")
    _drop(spark, f"{root}/{VISITORS}", days)
    # Every day has its zero rows at least, so the overwrite replaces them all.
    order = ["metric", "hour", F.desc("hits"), "name"]
    figures = day_metrics(requests, stale, visits, log)
    write_partitioned(figures, f"{root}/{METRICS}", DAY_KEYS, order)
    write_visitors(rollups.visitor_days_of(rollups.visitors_of_pages(visits)), root)
    mark_done(spark, stale, root)
    return stale


def refresh(
    spark: SparkSession,
    log: Log,
    wanted: DataFrame,
    root: str,
    bots: BotMap | DataFrame,
    as_of: DateLike,
    forced: Column | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Sync the log, then rebuild what depends on it. Returns the executed plan."""
    plan = sync_log(spark, log, wanted, root, as_of, forced, listing)
    rebuild_tables(spark, wanted, plan, root, bots)
    return plan


def read_day_metrics(
    spark: SparkSession, root: str, first: DateLike | None = None, last: DateLike | None = None
) -> DataFrame:
    """The stored day figures of a day range."""
    table = spark.read.schema(DAY_METRICS_SCHEMA).parquet(f"{root}/{METRICS}")
    return day_partitions(table, first, last)
