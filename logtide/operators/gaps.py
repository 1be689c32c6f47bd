"""Sitemap URLs the search crawler has not fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.urls import url_path


def sitemap_gaps(sitemap: DataFrame, crawled: DataFrame, months: DataFrame) -> DataFrame:
    """``(domain, month, pos, loc)`` of the entries without a crawler hit that month.

    ``crawled`` has one row per (site, month, path) and ``months`` the months to
    report per site. Repeated entries stay, in sitemap order.
    """
    wanted = sitemap.select("domain", "pos", "loc", url_path(F.col("loc")).alias("path")).join(
        months, "domain"
    )
    fetched = crawled.select("domain", "month", "path")
    return wanted.join(fetched, ["domain", "month", "path"], "left_anti").select(
        "domain", "month", "pos", "loc"
    )


#: Parts a site's month is cut into before its first gaps are picked.
PARTS = 64


def gap_summary(gaps: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` gaps per site and month, and how many more there are.

    The gaps are worked out once. Each part of a month gives its first gaps and
    its number of gaps, so the second step meets ``PARTS`` times ``limit`` rows
    at most, however many gaps a month has.
    """
    month = ["domain", "month"]
    part = F.pmod(F.xxhash64("pos", "loc"), F.lit(PARTS)).alias("part")
    in_part, in_month = Window.partitionBy(*month, "part"), Window.partitionBy(*month)
    first = (
        gaps.select(*month, "pos", "loc", part)
        .withColumn("place", F.row_number().over(in_part.orderBy("pos", "loc")))
        .withColumn("n", F.count("*").over(in_part))
        .where(F.col("place") <= limit)
    )
    # Every part is counted at its first gap.
    n = F.sum(F.when(F.col("place") == 1, F.col("n"))).over(in_month)
    return (
        first.withColumn("total", n)
        .withColumn("rank", F.row_number().over(in_month.orderBy("pos", "loc")))
        .where(F.col("rank") <= limit)
        .select(
            *month, "pos", "loc", F.greatest(F.col("total") - limit, F.lit(0)).cast("bigint").alias("more")
        )
    )
