"""Folders and file listings. Only names and sizes pass through the driver."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.schema import MIN_PARQUET_BYTES

#: Rows up to which a key table (sites x days, or files) is broadcast. It decides
#: the join's plan, never its result.
BROADCAST_ROWS = 1_000_000


def glob_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a Hadoop glob pattern; none is not an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = file_system.globStatus(path) or []
    return [status.getPath().toString() for status in matches if status.isDirectory()]


def glob_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a Hadoop glob pattern; none is not an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = file_system.globStatus(path) or []
    return [status.getPath().toString() for status in matches if status.isFile()]


def path_exists(spark: SparkSession, location: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def file_uri(spark: SparkSession, location: str) -> str:
    """A location in the form Spark's file metadata shows it."""
    return spark._jvm.org.apache.hadoop.fs.Path(location).toUri().toString()


def without_scheme(location: Column) -> Column:
    """``s3a://bucket/x``, ``file:///x`` and ``/x`` in one comparable form."""
    return F.regexp_replace(location, "^([A-Za-z][A-Za-z0-9+.-]*:)?/+", "")


def partition_name(spark: SparkSession, value: str) -> str:
    """A partition value the way Spark writes it into a folder name."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.escapePathName(value)


def day_globs(
    spark: SparkSession,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> list[str]:
    """Patterns of a table's day folders: of some sites, and of the months of a range.

    Only patterns that match a folder are returned, so a listing or a scan of
    them looks at no other site or month.
    """
    names = "*"
    if domains is not None:
        names = "{" + ",".join(partition_name(spark, d) for d in domains) + "}"
    months = ["*"]
    if first is not None and last is not None:
        months = [f"{y:04d}-{m:02d}-*" for y, m in months_between(first, last)]
    patterns = [f"{table}/domain={names}/dt={month}" for month in months]
    return [pattern for pattern in patterns if glob_folders(spark, pattern)]


def months_between(first: date, last: date) -> list[tuple[int, int]]:
    """``(year, month)`` of every month a day range touches."""
    span = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [(n // 12, n % 12 + 1) for n in span]


def complete_versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The numbered versions of a small table that were written whole, and their folders."""
    found = {}
    for version in glob_folders(spark, f"{folder}/version=*"):
        number = re.search(r"version=(\d+)$", version)
        if number and path_exists(spark, f"{version}/_SUCCESS"):
            found[int(number[1])] = version
    return found


def file_name(path: str) -> Column:
    """The last part of a path."""
    return F.substring_index(F.col(path), "/", -1)


def day_listing(
    spark: SparkSession,
    table: str,
    domains: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """``(domain, dt, path, length, modified)`` of all files in a table's day folders.

    The listing is a Spark scan that never opens a file. A table, site or range
    without folders has no files. Files without a byte are not seen, as Spark
    passes over them in any scan.
    """
    globs = day_globs(spark, table, domains, first, last)
    if not globs:
        return spark.createDataFrame([], _DAY_FILES)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("basePath", table)
        .load(globs)
        .select(
            F.col("domain").cast("string"),
            F.col("dt").cast("date"),
            "path",
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )
    if first is not None and last is not None:
        files = files.where(F.col("dt").between(F.lit(first), F.lit(last)))
    return files


_DAY_FILES = "domain string, dt date, path string, length bigint, modified timestamp"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def removed_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are deleted at the end, also after an error."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        drop_partitions(spark, made)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared scratch space.

    The space is the one ``spark.checkpoint.dir`` names. Only a local session
    that names none gets a machine-local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    elif spark.conf.get("spark.master", "").startswith("local"):
        folder = f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/{name}"
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = _scratch.get()
    if made is not None:
        made.append(folder)
    return folder


def settled(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Write a small table to shared scratch space and read it back.

    For a plan that looks at tables its job then rewrites: a cached copy could
    be lost with its executor and come out different when computed again.
    """
    folder = fresh_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def drop_partitions(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete partition folders; one that is not there is no error."""

    def drop(folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    # Object stores answer slowly, so some calls run at a time.
    with ThreadPoolExecutor(max_workers=16) as pool:
        list(pool.map(drop, folders))


def mark(spark: SparkSession, location: str, text: str = "") -> None:
    """Create a small file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.writeBytes(text)
    out.close()


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """Mark a key table for broadcast after counting that it is small enough.

    A larger one is left to the planner, which then joins by shuffle.
    """
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(keys) if small else keys


def file_stamp(spark: SparkSession, location: str) -> list[int] | None:
    """Length and time of the last change of a file, if it exists."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(path):
        return None
    status = file_system.getFileStatus(path)
    return [status.getLen(), status.getModificationTime()]
