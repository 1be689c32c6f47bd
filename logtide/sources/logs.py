"""Access-log tables: raw delivery folders and the compacted day table.

Raw files lie in ``<log_path>/YYYY/MM/DD[/HH]`` or, in the Hive style, in
``<log_path>/year=YYYY/month=MM/day=DD[/hour=HH]``. The compacted table, like
every table this engine writes, is partitioned by ``domain`` and ``dt``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from functools import reduce
from itertools import product

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logtide.functions.calendars import DateLike, date_column
from logtide.schema import (
    DAY_KEYS,
    LOG_SCHEMA,
    MIN_PARQUET_BYTES,
    NARROW_COLUMNS,
    NARROW_SCHEMA,
)
from logtide.sources.commits import partition_files, without_leftovers
from logtide.sources.lookups import Site, local_table
from logtide.sources.storage import (
    broadcast_if_small,
    day_globs,
    day_listing,
    file_uri,
    glob_folders,
    months_between,
    without_scheme,
)

_DAY_FOLDER = r"(?:year=)?(\d{4})/(?:month=)?(\d{2})/(?:day=)?(\d{2})"


@dataclass(frozen=True)
class DayFolder:
    domain: str
    dt: date
    path: str


def compact_path(log_path: str) -> str:
    """Where the compacted form of a raw log belongs."""
    base = log_path.rstrip("/")
    return base.removesuffix("/raw") + "/compact"


def day_partitions(table: DataFrame, first: DateLike | None, last: DateLike | None) -> DataFrame:
    """Rows of an inclusive day range; only those partitions are read."""
    if first is not None:
        table = table.where(F.col("dt") >= date_column(first))
    if last is not None:
        table = table.where(F.col("dt") <= date_column(last))
    return table


def read_narrow(
    spark: SparkSession,
    table: str,
    first: DateLike | None = None,
    last: DateLike | None = None,
    domains: Sequence[str] | None = None,
) -> DataFrame:
    """The report columns of a compacted (or narrow) table.

    The schema is fixed, so no footer is read to infer it and the scan takes
    only these columns of the file, however wide it is. Only folders of the
    sites and months asked for are listed. The size test prunes files that
    cannot be Parquet before they are opened, and files of a write that did not
    end are left out.
    """
    known = isinstance(first, date) and isinstance(last, date)
    globs = day_globs(spark, table, domains, *((first, last) if known else ()))
    if not globs:
        return spark.createDataFrame([], LOG_SCHEMA).select(*DAY_KEYS, *NARROW_COLUMNS)
    log = spark.read.schema(LOG_SCHEMA).option("basePath", table).parquet(*globs)
    log = log.where(F.col("_metadata.file_size") >= MIN_PARQUET_BYTES)
    log = without_leftovers(log, table, domains, *((first, last) if known else ()))
    return day_partitions(log, first, last).select(*DAY_KEYS, *NARROW_COLUMNS)


def raw_day_folders(
    spark: SparkSession, sites: Sequence[Site], first: date, last: date
) -> list[DayFolder]:
    """The day folders that exist in a date range; sites without a raw log have none.

    One listing per site and month, many at a time.
    """

    def of_month(wanted: tuple[Site, tuple[int, int]]) -> list[DayFolder]:
        site, (year, month) = wanted
        pattern = (
            f"{site.log_path.rstrip('/')}/{{{year:04d},year={year:04d}}}"
            f"/{{{month:02d},month={month:02d}}}/*"
        )
        found = []
        for path in glob_folders(spark, pattern):
            parts = re.search(_DAY_FOLDER + "$", path)
            if parts:
                found.append(DayFolder(site.domain, date(*map(int, parts.groups())), path))
        return found

    wanted = list(product([s for s in sites if s.log_path], months_between(first, last)))
    with ThreadPoolExecutor(max_workers=16) as pool:
        folders = [folder for found in pool.map(of_month, wanted) for folder in found]
    return [folder for folder in folders if first <= folder.dt <= last]


_RAW_FILES = (
    "domain string, dt date, file_path string, path string, length bigint, modified timestamp"
)


def raw_listing(spark: SparkSession, folders: list[DayFolder]) -> DataFrame:
    """``(domain, dt, file_path, path, length, modified)`` of all raw files, none opened.

    ``file_path`` is the form in which a scan's rows name their file. The folder
    is cut out of it here, once per file.
    """
    if not folders:
        return spark.createDataFrame([], _RAW_FILES)
    keys = local_table(
        spark,
        {
            "folder": ([file_uri(spark, f.path) for f in folders], pa.string()),
            "domain": ([f.domain for f in folders], pa.string()),
            "dt": ([f.dt for f in folders], pa.date32()),
        },
    ).withColumn("folder", without_scheme(F.col("folder")))
    folder = F.regexp_extract("file_path", f"^(.*/{_DAY_FOLDER})/", 1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([f.path for f in folders])
        .select(
            "path",
            "length",
            F.col("modificationTime").alias("modified"),
            F.col("_metadata.file_path").alias("file_path"),
        )
        .withColumn("folder", without_scheme(folder))
        .join(keys, "folder")
        .select(*DAY_KEYS, "file_path", "path", "length", "modified")
    )


def raw_files(spark: SparkSession, folders: list[DayFolder]) -> DataFrame:
    """The raw files that are large enough to be Parquet."""
    return raw_listing(spark, folders).where(F.col("length") >= MIN_PARQUET_BYTES)


def _scan(spark: SparkSession, folders: list[DayFolder], schema: StructType) -> DataFrame:
    """Rows of the raw files with the plain path of their file; tiny files are not opened."""
    files = spark.read.schema(schema).option("recursiveFileLookup", "true")
    rows = files.parquet(*[f.path for f in folders])
    return rows.where(F.col("_metadata.file_size") >= MIN_PARQUET_BYTES).select(
        "*", F.col("_metadata.file_path").alias("file_path")
    )


def _with_days(spark: SparkSession, rows: DataFrame, folders: list[DayFolder]) -> DataFrame:
    """Replace ``file_path`` by the site and day of the file."""
    days = raw_files(spark, folders).select(*DAY_KEYS, "file_path")
    return rows.join(broadcast_if_small(days), "file_path").drop("file_path")


def _merged_schema(spark: SparkSession, folders: list[DayFolder]) -> StructType:
    # A file too small for a footer must not keep the others from being read. A
    # larger broken one still fails when it is scanned.
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true")
    return reader.option("recursiveFileLookup", "true").parquet(*[f.path for f in folders]).schema


def _schema_groups(
    spark: SparkSession, folders: list[DayFolder]
) -> list[tuple[StructType, list[DayFolder]]]:
    """Folders by the merged schema of their site, or of the day if a site's days conflict."""
    by_site: dict[str, list[DayFolder]] = {}
    for folder in folders:
        by_site.setdefault(folder.domain, []).append(folder)

    def schemas(own: list[DayFolder]) -> list[tuple[StructType, list[DayFolder]]]:
        try:
            return [(_merged_schema(spark, own), own)]
        except (PySparkException, Py4JJavaError) as error:
            if len(own) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(error):
                raise
            return [(_merged_schema(spark, [folder]), [folder]) for folder in own]

    with ThreadPoolExecutor(max_workers=16) as pool:
        found = [pair for pairs in pool.map(schemas, by_site.values()) for pair in pairs]
    groups: dict[str, tuple[StructType, list[DayFolder]]] = {}
    for schema, own in found:
        groups.setdefault(schema.json(), (schema, []))[1].extend(own)
    return list(groups.values())


def read_raw(spark: SparkSession, folders: list[DayFolder]) -> DataFrame:
    """All columns of the raw files of the given days, plus ``domain`` and ``dt``.

    A column that only some files have is kept, null elsewhere. A column that
    has different types at different sites or days becomes a string.
    """
    held = {(r.domain, r.dt) for r in raw_files(spark, folders).select(*DAY_KEYS).distinct().collect()}
    folders = [f for f in folders if (f.domain, f.dt) in held]
    if not folders:
        return read_raw_narrow(spark, folders)
    groups = _schema_groups(spark, folders)
    types: dict[str, set[str]] = {}
    for schema, _ in groups:
        for field in schema.fields:
            types.setdefault(field.name, set()).add(field.dataType.json())
    scans = []
    for schema, own in groups:
        scan = _scan(spark, own, schema)
        unlike = {f.name: F.col(f.name).cast("string") for f in schema.fields if len(types[f.name]) > 1}
        scans.append(scan.withColumns(unlike) if unlike else scan)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return _with_days(spark, rows, folders)


def read_raw_narrow(spark: SparkSession, folders: list[DayFolder]) -> DataFrame:
    """The report columns of the raw files; the fixed schema needs no footer scan."""
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA)
    return _with_days(spark, _scan(spark, folders, NARROW_SCHEMA), folders)


def raw_rows(spark: SparkSession, folders: list[DayFolder]) -> DataFrame:
    """``(domain, dt, rows)``: rows are counted by file, from the footers, and files by day."""
    if not folders:
        return spark.createDataFrame([], "domain string, dt date, rows bigint")
    counted = _scan(spark, folders, NARROW_SCHEMA).groupBy("file_path").agg(F.count("*").alias("rows"))
    return _with_days(spark, counted, folders).groupBy(*DAY_KEYS).agg(F.sum("rows").alias("rows"))


class LogSource:
    """The log of some sites and a day range: compacted days, and raw files of the others."""

    def __init__(
        self, spark: SparkSession, sites: Sequence[Site], table: str, first: date, last: date
    ):
        self.spark, self.table, self.first, self.last = spark, table, first, last
        self.domains = [site.domain for site in sites]
        self.stored = partition_files(spark, table, self.domains, first, last)
        # One row per partition folder, so the set stays at (sites x days) entries.
        done = {(r.domain, r.dt) for r in self.stored.select(*DAY_KEYS).distinct().collect()}
        self.folders = [
            f for f in raw_day_folders(spark, sites, first, last) if (f.domain, f.dt) not in done
        ]

    def listing(self) -> DataFrame:
        """``(domain, dt, source, files, bytes, newest)`` of every day that has files."""
        compacted = self.stored.select(*DAY_KEYS, F.lit("compact").alias("source"), "length", "modified")
        raw = raw_files(self.spark, self.folders)
        raw = raw.select(*DAY_KEYS, F.lit("raw").alias("source"), "length", "modified")
        return compacted.unionByName(raw).groupBy(*DAY_KEYS, "source").agg(
            F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modified").alias("newest")
        )

    def tiny_files(self) -> DataFrame:
        """``(domain, dt, files)``: files passed over because they cannot be Parquet."""
        stored = day_listing(self.spark, self.table, self.domains, self.first, self.last)
        raw = raw_listing(self.spark, self.folders)
        files = stored.select(*DAY_KEYS, "length").unionByName(raw.select(*DAY_KEYS, "length"))
        tiny = files.where(F.col("length") < MIN_PARQUET_BYTES)
        return tiny.groupBy(*DAY_KEYS).agg(F.count("*").alias("files"))

    def rows(self, days: set[tuple[str, date]] | None = None) -> DataFrame:
        """Report columns of the whole range, or of some days."""
        compacted = read_narrow(self.spark, self.table, self.first, self.last, self.domains)
        folders = self.folders
        if days is not None:
            folders = [f for f in folders if (f.domain, f.dt) in days]
        if not folders:
            return compacted
        return compacted.unionByName(read_raw_narrow(self.spark, folders).select(*compacted.columns))


def read_log(
    spark: SparkSession, sites: Sequence[Site], table: str, first: date, last: date
) -> DataFrame:
    """Report columns of a date range: compacted days, and raw files of the others."""
    return LogSource(spark, sites, table, first, last).rows()
