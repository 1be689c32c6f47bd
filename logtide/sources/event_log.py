"""An access log derived from the ``events`` and ``pages`` tables.

Gives the reports a multi-site log to run on: every event is one request, and
the page it asks for is ``event_id`` modulo the number of pages. Days move by the
third of the month they are in, so that the log covers three months of two
years; some rows have an impossible hour or the date of another day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.schema import DAY_KEYS, NARROW_COLUMNS
from logtide.sources.lookups import Site

SITES = [Site("a.example.com"), Site("b.example.org")]
BOTS = [
    ("Googlebot-Image", "Google Images"),
    ("Googlebot", "Google"),
    ("DuckDuckBot", "DuckDuckGo"),
    ("bingbot", "Bing"),
    ("AhrefsBot", "Ahrefs"),
    ("SemrushBot", "Semrush"),
    ("YandexBot", "Yandex"),
    ("Applebot", "Apple"),
]

_DAY = "date_add(CAST(ts AS DATE), CASE WHEN day(ts) <= 20 THEN -10 ELSE 11 END)"
_DATE = f"CASE WHEN event_id % 59 = 0 THEN '2024-03-15' ELSE CAST({_DAY} AS STRING) END"
_TIME = """
    concat(CASE WHEN event_id % 53 = 0 THEN '25' ELSE substring(CAST(ts AS STRING), 12, 2) END,
           substring(CAST(ts AS STRING), 14, 6))"""
_DOMAIN = "CASE WHEN event_id % 3 = 0 THEN 'b.example.org' ELSE 'a.example.com' END"
_IP = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id AS STRING)) END"
_METHOD = "CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END"
_STEM = """
    concat(regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1),
           CASE page_id % 8 WHEN 1 THEN '.css' WHEN 2 THEN '.MJS' WHEN 3 THEN '.png'
                            WHEN 4 THEN '.woff2' WHEN 5 THEN '.json' WHEN 6 THEN '.d/index'
                            ELSE '' END)"""
_STATUS = """
    CASE WHEN event_type = 'error' THEN '404' WHEN event_id % 5 = 0 THEN '304' ELSE '200' END"""
_REFERER = """
    CASE event_id % 7 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN url
                      WHEN 4 THEN 'https://A.Example.com/x' WHEN 5 THEN 'android-app://com.app'
                      ELSE 'https://search.example.net?q=1' END"""
_AGENT = """
    CASE user_id % 16 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
                      WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)'
                      WHEN 2 THEN NULL WHEN 3 THEN ''
                      WHEN 4 THEN 'Googlebot-Image/1.0'
                      WHEN 5 THEN 'DuckDuckBot/1.1 (like bingbot)'
                      WHEN 6 THEN 'AhrefsBot/7.0' WHEN 7 THEN 'SemrushBot/7'
                      WHEN 8 THEN 'Mozilla/5.0 (compatible; YandexBot/3.0)'
                      WHEN 9 THEN 'Applebot/0.1' WHEN 10 THEN 'UnknownBot/1.0'
                      ELSE 'Mozilla/5.0' END"""


# The schemas of the given tables; naming them saves a footer read per query.
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
_PAGES = "page_id bigint, url string"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with the columns of a day-partitioned narrow table.

    The left join keeps every event, and lets Spark drop the join where only
    the date bounds are asked for.
    """
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.schema(_PAGES).parquet(f"{sf_dir}/pages.parquet")
    page_count = pages.agg(F.max("page_id") + 1).scalar()
    # The path depends on the page alone, so it is cut out of the URL once per
    # page and not once per request.
    paths = pages.selectExpr("page_id", "url", f"{_STEM} AS stem")
    requests = events.withColumn("page_id", F.col("event_id") % page_count).join(
        paths, "page_id", "left"
    )
    return requests.selectExpr(
        f"{_DOMAIN} AS domain",
        f"{_DAY} AS dt",
        f"{_DATE} AS date",
        f"{_TIME} AS time",
        f"{_IP} AS c_ip",
        f"{_METHOD} AS cs_method",
        "stem AS cs_uri_stem",
        f"{_STATUS} AS sc_status",
        f"{_REFERER} AS cs_Referer",
        f"{_AGENT} AS cs_User_Agent",
    ).select(*DAY_KEYS, *NARROW_COLUMNS)


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL once per site, in page order."""
    pages = spark.read.schema(_PAGES).parquet(f"{sf_dir}/pages.parquet")
    domains = F.array(*[F.lit(site.domain) for site in SITES])
    return pages.select(
        F.explode(domains).alias("domain"), F.col("page_id").alias("pos"), F.col("url").alias("loc")
    )
