"""Small access logs for the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.calendars import parse_date
from logtide.operators.requests import classify
from logtide.schema import NARROW_SCHEMA

HUMAN = "Mozilla/5.0"
GOOGLE = "Mozilla/5.0 (compatible; Googlebot/2.1)"
BING = "Mozilla/5.0 (compatible; bingbot/2.0)"
BOTS = [("Googlebot", "Google"), ("bingbot", "Bing")]
DAY = "2026-03-01"


def row(
    date=DAY,
    time="10:00:00",
    ip="1.1.1.1",
    method="GET",
    path="/",
    status="200",
    referer="-",
    agent=HUMAN,
):
    return (date, time, ip, method, path, status, referer, agent)


def log(spark: SparkSession, rows: list[tuple], domain: str = "example.com", day=None) -> DataFrame:
    """Rows as a day-partitioned log; ``day`` forces all into one day's partition."""
    frame = spark.createDataFrame(rows, NARROW_SCHEMA)
    dt = F.lit(day).cast("date") if day else parse_date(F.col("date"))
    return frame.withColumn("domain", F.lit(domain)).withColumn("dt", dt)


def requests(spark: SparkSession, rows: list[tuple], domain="example.com", day=None) -> DataFrame:
    return classify(log(spark, rows, domain, day), BOTS)


def rows_of(frame: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sorted tuples, dates as text."""
    picked = frame.select(*columns) if columns else frame
    return sorted(
        (tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in picked.collect()),
        key=repr,
    )
