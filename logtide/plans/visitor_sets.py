"""Exact visitors as bitmaps, so that ranges and years need no visitor rows.

Every address of a site has a number that stays its own, counted from 1 without
gaps. A day is stored as two bitmaps over these numbers, one of all visitors and
one of bots, in blocks of 32,768 numbers (4 KB). Bitmaps of days are merged with
a bitwise or: the visitors of any range are the set bits of the merged blocks,
and an address is a bot in the range if it was one on any day of it. What a
range reads and shuffles no longer grows with how often visitors come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.calendars import GRAIN_COLUMNS, DateLike
from logtide.operators.rollups import by_period
from logtide.plans.tables import write_partitioned
from logtide.schema import DAY_KEYS, VISITOR_NUMBER_SCHEMA, VISITOR_SET_SCHEMA
from logtide.sources.logs import day_partitions
from logtide.sources.storage import complete_versions, glob_folders, settled

#: Addresses and their numbers, and the bitmaps of the days, below the cache's root.
NUMBERS = "visitor_numbers"
SETS = "visitor_sets"
#: Parts of a site's new addresses that are numbered side by side.
NUMBERING_PARTS = 4_096

_ADDRESS = ["domain", "c_ip"]


def read_numbers(spark: SparkSession, root: str) -> DataFrame:
    """``(domain, c_ip, number)`` of all addresses numbered so far."""
    versions = complete_versions(spark, f"{root}/{NUMBERS}")
    if not versions:
        return spark.createDataFrame([], VISITOR_NUMBER_SCHEMA)
    return spark.read.schema(VISITOR_NUMBER_SCHEMA).parquet(*versions.values())


def number_addresses(spark: SparkSession, root: str, visitor_rows: DataFrame) -> None:
    """Give numbers to the addresses of visitor rows that have none yet.

    New addresses are dealt to parts by hash; parts are counted, follow each
    other, and are numbered inside. So no task holds more than a part of a site,
    also where one site has most of the addresses. The new numbers are one
    version, which counts once it is whole: numbers given before never change,
    and a run that ends early has given none. One job at a time may number.
    """
    known = read_numbers(spark, root)
    new = visitor_rows.select(*_ADDRESS).distinct().join(known, _ADDRESS, "left_anti")
    part = F.pmod(F.xxhash64(*_ADDRESS), F.lit(NUMBERING_PARTS))
    new = settled(spark, new.withColumn("part", part), "new-addresses")
    if new.isEmpty():
        return
    sizes = new.groupBy("domain", "part").agg(F.count("*").alias("n"))
    last = known.groupBy("domain").agg(F.max("number").alias("last"))
    earlier = Window.partitionBy("domain").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce("last", F.lit(0)) + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = sizes.join(last, "domain", "left").select("domain", "part", start.alias("start"))
    place = F.row_number().over(Window.partitionBy("domain", "part").orderBy("c_ip"))
    numbered = new.join(starts, ["domain", "part"]).select(*_ADDRESS, (F.col("start") + place).alias("number"))
    folder = f"{root}/{NUMBERS}"
    version = max(complete_versions(spark, folder), default=0) + 1
    # A version that a run has not written whole is overwritten.
    numbered.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/version={version}")


def day_sets(visitor_rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(domain, dt, block, visitors, bots)`` from ``rollups.visitor_days`` rows.

    Rows are dealt by block before they become bitmaps. A block has at most
    32,768 rows a day, so no group is large, and the shuffle moves numbers
    instead of nearly empty bitmaps of every task.
    """
    keys = [*DAY_KEYS, "block"]
    rows = visitor_rows.join(numbers, _ADDRESS).select(
        *DAY_KEYS,
        F.bitmap_bucket_number("number").alias("block"),
        F.bitmap_bit_position("number").alias("bit"),
        "is_bot",
    )
    return rows.repartition(*keys).groupBy(*keys).agg(
        F.bitmap_construct_agg("bit").alias("visitors"),
        F.bitmap_construct_agg(F.when(F.col("is_bot"), F.col("bit"))).alias("bots"),
    )


def write_days(spark: SparkSession, root: str, visitor_rows: DataFrame) -> None:
    """Store the bitmaps of the days of visitor rows in place of earlier ones.

    Addresses are numbered first. A run that ends in between can be run again;
    a number without a bit counts nowhere. Days without rows are left alone.
    """
    number_addresses(spark, root, visitor_rows)
    sets = day_sets(visitor_rows, read_numbers(spark, root))
    write_partitioned(sets, f"{root}/{SETS}", DAY_KEYS, ["block"])


def read_days(
    spark: SparkSession, root: str, first: DateLike | None = None, last: DateLike | None = None
) -> DataFrame:
    """Bitmaps of a day range; other days are not listed into the scan."""
    table = f"{root}/{SETS}"
    if not glob_folders(spark, f"{table}/domain=*"):
        return spark.createDataFrame([], VISITOR_SET_SCHEMA)
    return day_partitions(spark.read.schema(VISITOR_SET_SCHEMA).parquet(table), first, last)


def merged(sets: DataFrame, grain: str) -> DataFrame:
    """Bitmaps of months or years from those of days, or of years from months with a ``dt``."""
    either = [F.bitmap_or_agg(c).alias(c) for c in ("visitors", "bots")]
    return by_period(sets, grain, ["block"], *either)


def _counted(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return blocks.groupBy(*keys).agg(
        F.sum(F.bitmap_count("visitors")).alias("visitors"),
        F.sum(F.bitmap_count("bots")).alias("bot_visitors"),
    )


def range_visitors(sets: DataFrame) -> DataFrame:
    """Exact unique visitors per site of all days in ``sets``."""
    either = [F.bitmap_or_agg(c).alias(c) for c in ("visitors", "bots")]
    return _counted(sets.groupBy("domain", "block").agg(*either), ["domain"])


def period_visitors(sets: DataFrame, grain: str) -> DataFrame:
    """Exact unique visitors per site and month or year."""
    return _counted(merged(sets, grain), ["domain", GRAIN_COLUMNS[grain]])
