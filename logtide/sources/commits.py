"""Which files of a day-partitioned table count.

A write that ends early can leave some of its files behind, and one that
replaces days has to leave the old files until the new ones are complete. So a
table lists its files: every finished write adds the files of the days it wrote,
as a version that counts once it is complete, and the last version that names a
day has all of its files. Files that are not listed don't count. A table that
lists nothing is one that other programs write; all its files count.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.schema import DAY_KEYS, MIN_PARQUET_BYTES
from logtide.sources.lookups import local_table
from logtide.sources.storage import (
    broadcast_if_small,
    complete_versions,
    day_listing,
    drop_partitions,
    file_name,
)

COMMITS = "_commits"
_FILES = "domain string, dt date, file string"
#: Versions that are merged into one when there are more.
MOST_VERSIONS = 64


def _folder(table: str) -> str:
    return f"{table}/{COMMITS}"


def committed_files(spark: SparkSession, table: str) -> DataFrame | None:
    """``(domain, dt, file)`` of the files that count; none if the table lists nothing."""
    versions = complete_versions(spark, _folder(table))
    if not versions:
        return None
    rows = (
        spark.read.schema(f"{_FILES}, version long")
        .option("basePath", _folder(table))
        .parquet(*versions.values())
    )
    last = rows.groupBy(*DAY_KEYS).agg(F.max("version").alias("version"))
    return rows.join(last, [*DAY_KEYS, "version"]).select(*DAY_KEYS, "file")


#: A file there is: its site, day and path.
File = tuple[str, date, str]


def _write(spark: SparkSession, table: str, files: DataFrame) -> None:
    number = max(complete_versions(spark, _folder(table)), default=-1) + 1
    files.select(*DAY_KEYS, "file").coalesce(1).write.mode("overwrite").parquet(
        f"{_folder(table)}/version={number}"
    )


def _named(spark: SparkSession, files: Iterable[File]) -> DataFrame:
    """Files as rows; the names are those a listing holds on the driver anyway."""
    rows = sorted(files)
    return local_table(
        spark,
        {
            "domain": ([domain for domain, _, _ in rows], pa.string()),
            "dt": ([dt for _, dt, _ in rows], pa.date32()),
            "file": ([path.rsplit("/", 1)[-1] for _, _, path in rows], pa.string()),
        },
    )


def present_files(
    spark: SparkSession,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> set[File]:
    """All files there are now, listed or not."""
    found = day_listing(spark, table, domains, first, last)
    return {(r["domain"], r["dt"], r["path"]) for r in found.select(*DAY_KEYS, "path").collect()}


def begin(spark: SparkSession, table: str) -> None:
    """Start to list the files of a table, those it has to begin with."""
    if not complete_versions(spark, _folder(table)):
        _write(spark, table, _named(spark, present_files(spark, table)))


def commit(spark: SparkSession, table: str, before: set[File], after: set[File]) -> None:
    """Put the files that came between two looks at the table in force, day by day.

    For the days they are of, all earlier files are replaced: they count no more
    from here on, and are deleted. A run that ends before this changes nothing
    for readers; one that ends between the two leaves files nobody reads, which
    the next write of the day deletes.
    """
    new = after - before
    if not new:
        return
    _write(spark, table, _named(spark, new))
    days = {(domain, dt) for domain, dt, _ in new}
    drop_partitions(spark, [path for domain, dt, path in before if (domain, dt) in days])
    merge(spark, table)


def merge(spark: SparkSession, table: str, most: int = MOST_VERSIONS) -> None:
    """Make one version of many. The older ones go once it is complete."""
    older = complete_versions(spark, _folder(table))
    if len(older) > most:
        _write(spark, table, committed_files(spark, table))
        drop_partitions(spark, older.values())


def day_files(
    spark: SparkSession,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """``(domain, dt, path, length, modified)`` of the files of a table that count."""
    found = day_listing(spark, table, domains, first, last)
    known = committed_files(spark, table)
    if known is None:
        return found
    named = found.withColumn("file", file_name("path"))
    return named.join(broadcast_if_small(known), [*DAY_KEYS, "file"], "left_semi").drop("file")


def partition_files(
    spark: SparkSession,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """The files of a table that count and are large enough to be Parquet."""
    return day_files(spark, table, domains, first, last).where(F.col("length") >= MIN_PARQUET_BYTES)


def partition_days(
    spark: SparkSession,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """``(domain, dt)`` of the days a table holds."""
    return partition_files(spark, table, domains, first, last).select(*DAY_KEYS).distinct()


def without_leftovers(
    rows: DataFrame,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """The rows of a scan of the table that come from files that count.

    Files that don't are looked for in a listing first. There are none but after
    a run that ended early, and then the scan is left as it is.
    """
    spark = rows.sparkSession
    known = committed_files(spark, table)
    if known is None:
        return rows
    keys = [*DAY_KEYS, "file"]
    found = day_listing(spark, table, domains, first, last).select(*DAY_KEYS, file_name("path").alias("file"))
    extra = found.join(broadcast_if_small(known), keys, "left_anti")
    if extra.isEmpty():
        return rows
    named = rows.withColumn("file", F.col("_metadata.file_name"))
    return named.join(broadcast_if_small(extra), keys, "left_anti").drop("file")
