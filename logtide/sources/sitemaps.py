"""Sitemap entries through Spark's XML source."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.sources.lookups import Site, local_table
from logtide.sources.storage import file_uri, path_exists, without_scheme

_log = logging.getLogger(__name__)

_SCHEMA = "domain string, pos bigint, loc string"


def _owners(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """``(domain, file)`` of the sites' sitemaps, files as a scan names them."""
    owners = local_table(
        spark,
        {
            "domain": ([s.domain for s in sites], pa.string()),
            "file": ([file_uri(spark, s.sitemap) for s in sites], pa.string()),
        },
    )
    return owners.withColumn("file", without_scheme(F.col("file")))


def _entries(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """All ``<url>`` entries of the files that exist, in one scan; a broken one has no ``loc``."""
    files = sorted({site.sitemap for site in sites})
    entries = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .option("mode", "PERMISSIVE")
        .schema("loc string")
        .load(files)
        .select(
            without_scheme(F.col("_metadata.file_path")).alias("file"),
            F.monotonically_increasing_id().alias("pos"),
            "loc",
        )
    )
    return entries.join(_owners(spark, sites), "file").select("domain", "pos", "loc")


def _present(spark: SparkSession, sites: Sequence[Site]) -> list[Site]:
    """The sites whose sitemap exists; a missing one gives a warning."""
    named = [site for site in sites if site.sitemap is not None]
    with ThreadPoolExecutor(max_workers=16) as pool:
        found = list(pool.map(lambda site: path_exists(spark, site.sitemap), named))
    for site, exists in zip(named, found, strict=True):
        if not exists:
            _log.warning("sitemap of %s not found: %s", site.domain, site.sitemap)
    return [site for site, exists in zip(named, found, strict=True) if exists]


#: What is wrong with a sitemap.
MISSING, EMPTY, NOT_XML, NO_ENTRIES, NO_LOCATION = "missing", "empty", "not_xml", "no_entries", "no_location"


def _file_problems(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """``(domain, problem)`` of files that exist, each parsed as one document.

    A sitemap is 50 MB at most, by its standard, so a file is a row. Spark's
    scans pass over files without a byte, which are those without a row.
    """
    if not sites:
        return spark.createDataFrame([], "domain string, problem string")
    files = spark.read.text(sorted({site.sitemap for site in sites}), wholetext=True)
    parsed = F.from_xml(
        "value",
        "url array<struct<loc: string>>, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    problem = (
        F.when(F.col("value").isNull() | (F.trim(F.translate("value", "\r\n\t", "   ")) == ""), EMPTY)
        .when(F.col("doc._bad").isNotNull(), NOT_XML)
        .when(F.coalesce(F.size("doc.url"), F.lit(0)) <= 0, NO_ENTRIES)
        .when(F.exists("doc.url", lambda url: url.isNull() | url["loc"].isNull()), NO_LOCATION)
    )
    found = files.select(without_scheme(F.col("_metadata.file_path")).alias("file"), "value")
    found = found.withColumn("doc", parsed).select("file", problem.alias("problem"), F.lit(True).alias("read"))
    return (
        _owners(spark, sites)
        .join(found, "file", "left")
        .select("domain", F.when(F.col("read").isNull(), EMPTY).otherwise(F.col("problem")).alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def sitemap_problems(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """``(domain, problem)`` of the sites whose sitemap can't be used.

    It is ``missing``, ``empty``, ``not_xml`` (cut off, say), has ``no_entries``
    or an entry with ``no_location``.
    """
    present = _present(spark, sites)
    missing = [s.domain for s in sites if s.sitemap is not None and s not in present]
    absent = local_table(spark, {"domain": (missing, pa.string())}).withColumn("problem", F.lit(MISSING))
    return absent.union(_file_problems(spark, present))


def read_sitemaps(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """``(domain, pos, loc)``: the ``<url><loc>`` entries of the sites in file order.

    ``pos`` rises in file order but has gaps. Only flat sitemaps are read. A
    missing file gives a warning and no entries, and a file with any problem
    (``sitemap_problems``) has none either.
    """
    present = _present(spark, sites)
    if not present:
        return spark.createDataFrame([], _SCHEMA)
    broken = _file_problems(spark, present).select("domain").distinct()
    return _entries(spark, present).join(broken, "domain", "left_anti")


def read_sitemap(spark: SparkSession, site: Site) -> DataFrame:
    """The entries of one site."""
    return read_sitemaps(spark, [site])


def unreadable_sitemaps(spark: SparkSession, sites: Sequence[Site]) -> DataFrame:
    """``(domain)`` of the sites whose sitemap can't be used."""
    return sitemap_problems(spark, sites).select("domain").distinct()
