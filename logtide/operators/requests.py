"""From log rows to classified requests. No shuffle happens here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions import requests as rq
from logtide.functions.requests import BotMap
from logtide.sources.lookups import bots_table

#: Patterns of a list that are tested one by one on every request.
BOT_CHAIN = 64
#: Characters of the substrings that patterns are looked up by.
GRAM = 4


def classify(log: DataFrame, bots: BotMap | DataFrame) -> DataFrame:
    """One classified row per request of the day its partition stands for.

    ``bots`` is the ordered bot list, or a bot table; a list too long for a chain
    of conditions is looked up as a table. Missing addresses and paths count as ``''``, so
    a request without an address still is a visitor. Rows whose ``date`` is not
    the partition's day are dropped.
    """
    agent = F.coalesce("cs_User_Agent", F.lit(""))
    log = log.where(F.col("date") == F.col("dt").cast("string"))
    if not isinstance(bots, DataFrame) and len(bots) > BOT_CHAIN:
        bots = bots_table(log.sparkSession, bots)
    if isinstance(bots, DataFrame):
        # Patterns are looked up once per user agent. The agents may be many, so
        # which side is broadcast, if any, is the planner's choice by size.
        names = known_bots(log, bots)
        log = log.join(names.withColumnRenamed("ua", "cs_User_Agent"), "cs_User_Agent", "left")
        name = F.col("bot_name")
    else:
        name = rq.bot_name(agent, bots)
    return log.select(
        "domain",
        "dt",
        F.col("time"),
        F.coalesce("c_ip", F.lit("")).alias("c_ip"),
        F.coalesce("cs_uri_stem", F.lit("")).alias("path"),
        F.col("cs_Referer").alias("referer"),
        name.alias("bot_name"),
        rq.is_crawler(agent).alias("is_crawler"),
        rq.is_hit(F.col("cs_method"), F.col("sc_status")).alias("is_hit"),
    )


def hits(requests: DataFrame) -> DataFrame:
    """The requests that count as page views."""
    return requests.where("is_hit")


def classified_counts(requests: DataFrame) -> DataFrame:
    """Requests per (site, day, category, bot, hit or not)."""
    by_path = requests.withColumn("category", rq.path_category(F.col("path")))
    return by_path.groupBy("domain", "dt", "category", "bot_name", "is_hit").agg(
        F.count("*").alias("n")
    )


def bot_index(bots: DataFrame) -> DataFrame:
    """``(gram, priority, pattern, bot_name)``: each pattern under one of its substrings.

    Of a pattern's substrings of ``GRAM`` characters (its whole text, if it is
    shorter) the one that fewest patterns have, so a lookup finds few patterns.
    """
    size = F.least(F.char_length("pattern"), F.lit(GRAM))
    each = bots.where(F.col("pattern").isNotNull()).select(
        "priority", "pattern", "bot_name", F.explode(rq.grams(F.col("pattern"), size)).alias("gram")
    )
    often = F.count("*").over(Window.partitionBy("gram"))
    rarest = Window.partitionBy("priority", "pattern", "bot_name").orderBy("often", "gram")
    return (
        each.withColumn("often", often)
        .withColumn("place", F.row_number().over(rarest))
        .where(F.col("place") == 1)
        .select("gram", "priority", "pattern", "bot_name")
    )


def _user_agents(log: DataFrame) -> DataFrame:
    return log.select(F.coalesce("cs_User_Agent", F.lit("")).alias("ua")).distinct()


def known_bots(log: DataFrame, bots: DataFrame) -> DataFrame:
    """``(ua, bot_name)`` of the distinct user agents of the log that are a bot's.

    An agent meets only the patterns whose gram it holds, by an equi-join; the
    exact test and the priority decide between these.
    """
    index = bot_index(bots)
    sizes = index.agg(F.collect_set(F.char_length("gram"))).scalar()
    held = F.flatten(F.transform("sizes", lambda size: rq.grams(F.col("ua"), size)))
    # With explode_outer no filter reaches the agents, which bot_dimension reads
    # once more, from the same shuffle.
    looked_up = (
        _user_agents(log).withColumn("sizes", sizes).select("ua", F.explode_outer(held).alias("gram"))
    )
    return (
        looked_up.join(index, "gram")
        .where((F.col("ua") != "") & F.col("ua").contains(F.col("pattern")))
        .groupBy("ua")
        .agg(F.min(F.struct("priority", "pattern", "bot_name"))["bot_name"].alias("bot_name"))
    )


def bot_dimension(log: DataFrame, bots: DataFrame) -> DataFrame:
    """Bot name of every distinct user agent of the log, null for those of people."""
    return _user_agents(log).join(known_bots(log, bots), "ua", "left")


#: What the reports handle by a default, or leave out.
QUALITY_COLUMNS = ["stray_date_rows", "bad_hour_rows", "null_ip_rows", "null_ua_rows"]


def _quality_counts() -> list[Column]:
    own = F.col("date").eqNullSafe(F.col("dt").cast("string"))
    found = [
        ~own,
        own & (rq.request_hour(F.col("time")) > 23),
        own & F.col("c_ip").isNull(),
        own & F.col("cs_User_Agent").isNull(),
    ]
    return [F.count_if(f).alias(name) for f, name in zip(found, QUALITY_COLUMNS, strict=True)]


def data_quality(log: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Rows the reports handle by a default or leave out, per site (and day).

    Rows of another date than their day's are counted as such alone, as no
    report counts them.
    """
    return log.groupBy(*keys).agg(*_quality_counts())
