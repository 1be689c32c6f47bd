"""Compaction of many small raw files into sorted day partitions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.operators.calendars import site_days
from logtide.plans.tables import write_ordered
from logtide.schema import COMPACT_SORT_KEYS, COMPACT_WRITE_OPTIONS, DAY_KEYS, LOG_SCHEMA
from logtide.sources import commits
from logtide.sources.commits import partition_days, partition_files
from logtide.sources.logs import (
    DayFolder,
    raw_day_folders,
    raw_files,
    raw_rows,
    read_narrow,
    read_raw,
)
from logtide.sources.lookups import Site, sites_table
from logtide.sources.storage import settled

COMPACT = "compact"
EXISTS = "exists"
NO_RAW_FILES = "no_raw"

#: Bytes of a value, about, where only the number of rows is known.
COLUMN_BYTES = 16


def write_days(log: DataFrame, table: str, size: int | None = None) -> None:
    """Add the files of days sorted by the compaction keys the log has; none counts yet."""
    order = [c for c in COMPACT_SORT_KEYS if c in log.columns]
    if size is None:
        size = log.count() * len(log.columns) * COLUMN_BYTES
    write_ordered(log, table, DAY_KEYS, order, size, COMPACT_WRITE_OPTIONS)


def sort_and_write(
    log: DataFrame,
    table: str,
    size: int | None = None,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> None:
    """Write days sorted by the compaction keys the log has, in place of what they held.

    A day's files follow each other in the order of the keys and do not
    overlap, whatever the size of the day. ``size`` is that of the log in bytes,
    from which the number of files follows; without it rows are counted. The
    sites and range, if given, are all the log has, so that only their folders
    are listed. Readers see the days as they were until all files are there,
    and then as they are (``sources.commits``).
    """
    spark = log.sparkSession
    commits.begin(spark, table)
    span = (domains, first, last)
    before = commits.present_files(spark, table, *span)
    write_days(log, table, size)
    commits.commit(spark, table, before, commits.present_files(spark, table, *span))


def file_order(spark: SparkSession, table: str) -> DataFrame:
    """Per day: rows, first and last key, files, and how many begin before the one before ended.

    A key is the sort columns' text joined by a character below all others, and
    a null is the empty text.
    """
    texts = [F.coalesce(F.col(c), F.lit("")) for c in COMPACT_SORT_KEYS if c in LOG_SCHEMA.names]
    rows = read_narrow(spark, table).select(
        *DAY_KEYS, F.input_file_name().alias("file"), F.concat_ws("\x01", *texts).alias("key")
    )
    files = rows.groupBy(*DAY_KEYS, "file").agg(
        F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last")
    )
    before = Window.partitionBy(*DAY_KEYS).orderBy("first", "last")
    files = files.withColumn("overlaps", F.col("first") < F.lag("last").over(before))
    return files.groupBy(*DAY_KEYS).agg(
        F.sum("rows").alias("rows"),
        F.min("first").alias("first_key"),
        F.max("last").alias("last_key"),
        F.count("*").alias("files"),
        F.count_if("overlaps").alias("overlapping_files"),
    )


def _pending(
    spark: SparkSession,
    sites: Sequence[Site],
    table: str,
    first: date,
    last: date,
    force: bool,
) -> list[DayFolder]:
    folders = raw_day_folders(spark, sites, first, last)
    if force:
        return folders
    held = partition_days(spark, table, [s.domain for s in sites], first, last)
    # One row per partition folder, so the set stays at (sites x days) entries.
    done = {(r.domain, r.dt) for r in held.collect()}
    return [f for f in folders if (f.domain, f.dt) not in done]


def _no_counts(days: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return days.select(
        *DAY_KEYS, zero.alias("files"), zero.alias("raw_bytes"), zero.alias("rows")
    ).limit(0)


def _nothing_planned(days: DataFrame) -> DataFrame:
    return _no_counts(days).withColumn("action", F.lit(NO_RAW_FILES))


def _raw_counts(spark: SparkSession, folders: list[DayFolder], days: DataFrame) -> DataFrame:
    """Files, bytes and rows per day. Rows come from the Parquet footers alone."""
    if not folders:
        return _no_counts(days)
    listed = (
        raw_files(spark, folders)
        .groupBy(*DAY_KEYS)
        .agg(F.count("*").alias("files"), F.sum("length").alias("raw_bytes"))
    )
    return listed.join(raw_rows(spark, folders), DAY_KEYS, "left")


def _planned(
    spark: SparkSession,
    sites: Sequence[Site],
    table: str,
    first: date,
    last: date,
    as_of: date,
    force: bool,
) -> tuple[DataFrame, list[DayFolder]]:
    end = min(last, as_of - timedelta(days=1))
    days = site_days(sites_table(spark, sites), first, end)
    if end < first:
        return _nothing_planned(days), []
    todo = _pending(spark, sites, table, first, end, force)
    held = partition_days(spark, table, [s.domain for s in sites], first, end)
    existing = held.withColumn("compacted", F.lit(not force))
    action = (
        F.when(F.col("compacted"), EXISTS)
        .when(F.coalesce("rows", F.lit(0)) == 0, NO_RAW_FILES)
        .otherwise(COMPACT)
    )
    plan = (
        days.join(existing, DAY_KEYS, "left")
        .join(_raw_counts(spark, todo, days), DAY_KEYS, "left")
        .select(
            *DAY_KEYS,
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "raw_bytes", "rows")],
            action.alias("action"),
        )
    )
    return plan, todo


def compaction_plan(
    spark: SparkSession,
    sites: Sequence[Site],
    table: str,
    first: date,
    last: date,
    as_of: date,
    force: bool = False,
) -> DataFrame:
    """What a compaction run would do, per site and day; writes nothing.

    The day ``as_of`` and later ones are left out, as their files may still be
    growing. Days already in the table are left alone unless ``force`` is set.
    """
    return _planned(spark, sites, table, first, last, as_of, force)[0]


def compact(
    spark: SparkSession,
    sites: Sequence[Site],
    table: str,
    first: date,
    last: date,
    as_of: date,
    force: bool = False,
) -> DataFrame:
    """Compact the days of a range and return the summary per site and day."""
    plan, todo = _planned(spark, sites, table, first, last, as_of, force)
    # The plan looks at the table that is written next, so it is fixed first.
    plan = settled(spark, plan, "compaction-plan")
    size = plan.where(F.col("action") == COMPACT).agg(F.sum("raw_bytes")).first()[0]
    if size:
        sort_and_write(read_raw(spark, todo), table, size, [s.domain for s in sites], first, last)
    written = (
        partition_files(spark, table, [s.domain for s in sites], first, last)
        .groupBy(*DAY_KEYS)
        .agg(F.sum("length").alias("table_bytes"))
    )
    skipped = F.col("action") != COMPACT
    compact_bytes = F.when(skipped, F.lit(0)).otherwise(F.coalesce("table_bytes", F.lit(0)))
    ratio = F.col("raw_bytes") / F.greatest(F.col("compact_bytes"), F.lit(1))
    return (
        plan.join(written, DAY_KEYS, "left")
        .withColumn("compact_bytes", compact_bytes)
        .select(
            *DAY_KEYS,
            "files",
            "rows",
            "raw_bytes",
            "compact_bytes",
            ratio.alias("ratio"),
            skipped.alias("skipped"),
        )
    )


def run_totals(summary: DataFrame) -> DataFrame:
    """One line per site: days done and left, files, rows and bytes."""
    return summary.groupBy("domain").agg(
        F.count_if(~F.col("skipped")).alias("compacted_days"),
        F.count_if("skipped").alias("skipped_days"),
        F.sum("files").alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("compact_bytes").alias("compact_bytes"),
    )
