"""Table schemas and the fixed values that decide results."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# --- fixed values -----------------------------------------------------------

# The columns of an access log that the reports use, in file order.
NARROW_COLUMNS = [
    "date",
    "time",
    "c_ip",
    "cs_method",
    "cs_uri_stem",
    "sc_status",
    "cs_Referer",
    "cs_User_Agent",
]

# Row order inside a compacted day; a key the log does not have is left out.
COMPACT_SORT_KEYS = [
    "date",
    "x_edge_location",
    "sc_status",
    "cs_method",
    "cs_uri_stem",
    "time",
]

# A hit is a request with this method and one of these statuses.
HIT_METHOD = "GET"
HIT_STATUSES = ["200", "304"]

# User agents holding this text count as the search crawler of the gap report.
CRAWLER_TOKEN = "Googlebot"

# Asset category -> path extensions. Anything else is a "page". The order of
# the categories is the order of the static asset report.
ASSET_EXTENSIONS = {
    "css": ["css"],
    "js": ["js", "mjs"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "avif", "bmp"],
    "font": ["ttf", "woff", "woff2", "eot", "otf"],
    "data": ["xml", "json", "rss", "atom", "txt"],
}
PAGE_CATEGORY = "page"

# Lengths of the report lists.
TOP_PAGES = 15
TOP_BOTS = 5
TOP_BOTS_YEAR = 10
TOP_REFERERS = 15
TOP_GAPS = 15

# A smaller file cannot be Parquet and is passed over.
MIN_PARQUET_BYTES = 12

# Writer settings of a compacted day.
COMPACT_WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "3",
    "parquet.block.row.count.limit": "1048576",
    "parquet.page.size": "1048576",
    "parquet.enable.dictionary": "true",
}

# --- schemas ----------------------------------------------------------------

DAY_KEYS = ["domain", "dt"]

_day_fields = [
    StructField("domain", StringType()),
    StructField("dt", DateType()),
]

NARROW_SCHEMA = StructType([StructField(c, StringType()) for c in NARROW_COLUMNS])

#: A day-partitioned narrow log table: the file columns plus the partition keys.
LOG_SCHEMA = StructType(NARROW_SCHEMA.fields + _day_fields)

#: The visitor table: one row per (domain, day, address).
VISITOR_SCHEMA = StructType(
    [
        StructField("date", StringType(), False),
        StructField("c_ip", StringType(), False),
        StructField("is_bot", BooleanType(), False),
        *_day_fields,
    ]
)

#: The number of an address of a site, which it keeps.
VISITOR_NUMBER_SCHEMA = StructType(
    [
        StructField("domain", StringType(), False),
        StructField("c_ip", StringType(), False),
        StructField("number", LongType(), False),
    ]
)

#: The visitors of a day as bitmaps over their numbers, in blocks.
VISITOR_SET_SCHEMA = StructType(
    [
        StructField("block", LongType(), False),
        StructField("visitors", BinaryType(), False),
        StructField("bots", BinaryType(), False),
        *_day_fields,
    ]
)

#: The stored figures of a day: one row per metric and its key (an hour, a path,
#: a bot, a referer), all in one file per site and ordinary day.
DAY_METRICS_SCHEMA = StructType(
    [
        StructField("metric", StringType()),
        StructField("hour", IntegerType()),
        StructField("name", StringType()),
        StructField("hits", LongType()),
        StructField("visitors", LongType()),
        StructField("bot_hits", LongType()),
        StructField("bot_visitors", LongType()),
        StructField("last_crawl", DateType()),
        *_day_fields,
    ]
)

#: What is known of every day that was ever fetched: the files it came from, the
#: day it was fetched on, whether a run on it has not ended, and the number of the
#: state's version in which it was last made from other rows.
STATE_SCHEMA = StructType(
    [
        *_day_fields,
        StructField("source", StringType()),
        StructField("files", LongType()),
        StructField("bytes", LongType()),
        StructField("newest", TimestampType()),
        StructField("synced_on", DateType()),
        StructField("has_visitors", BooleanType()),
        StructField("pending", BooleanType()),
        StructField("revision", LongType()),
    ]
)

#: What a published month or year of a site was made from.
PERIOD_SCHEMA = StructType(
    [StructField(c, StringType()) for c in ("domain", "grain", "period", "out", "stamp")]
)
