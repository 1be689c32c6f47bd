"""Which months and years a report has to write again.

A published month of a site depends on the site's days in it, a year on its
months. Each gets a stamp: a checksum of all it is made from. What is published
is stored with its stamp, and only periods whose stamp is another one now are
dirty. Days bring their files and their revision, which grows whenever a day is
made from other rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.calendars import period_label
from logtide.plans.state import read_version, write_version
from logtide.schema import DAY_KEYS, PERIOD_SCHEMA
from logtide.sources.lookups import local_table
from logtide.sources.storage import broadcast_if_small

#: The stamps of what is published, below the cache's root.
PUBLISHED = "published"

_DAY_FACTS = ["source", "files", "bytes", "newest", "revision"]


@dataclass
class Dirty:
    """``(site, label)`` of the months and years to write: (sites x periods) at most."""

    months: set[tuple[str, str]] = field(default_factory=set)
    years: set[tuple[str, str]] = field(default_factory=set)

    def __bool__(self) -> bool:
        return bool(self.months or self.years)


def keys_table(spark: SparkSession, keys: Iterable[tuple[str, str]], column: str) -> DataFrame:
    """``(domain, column)`` of site and period keys."""
    ordered = sorted(keys)
    return local_table(
        spark,
        {
            "domain": ([domain for domain, _ in ordered], pa.string()),
            column: ([label for _, label in ordered], pa.string()),
        },
    )


def of_months(rows: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of some days; joined on the partition keys, so other folders are not read."""
    return rows.join(broadcast_if_small(days.select(*DAY_KEYS)), DAY_KEYS, "left_semi")


def _checksum(facts: Column) -> Column:
    """A checksum of a group's texts in their own order, which repeats do not change."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(facts)), "\n"), 256)


def month_stamps(
    days: DataFrame, state: DataFrame, tiny_files: DataFrame, site_facts: DataFrame
) -> DataFrame:
    """``(domain, grain, period, stamp)`` of the months of a calendar.

    ``site_facts`` has ``(domain, facts)``: what else the reports of a site
    depend on. A month that gains a day of the calendar has another stamp.
    """
    known = state.select(*DAY_KEYS, *_DAY_FACTS)
    tiny = tiny_files.select(*DAY_KEYS, F.col("files").alias("tiny"))
    facts = F.to_json(F.struct("dt", *_DAY_FACTS, "tiny", "facts"))
    return (
        days.join(known, DAY_KEYS, "left")
        .join(tiny, DAY_KEYS, "left")
        .join(site_facts, "domain", "left")
        .groupBy("domain", period_label(F.col("dt"), "month").alias("period"))
        .agg(_checksum(facts).alias("stamp"))
        .select("domain", F.lit("month").alias("grain"), "period", "stamp")
    )


def year_stamps(months: DataFrame, year: str) -> DataFrame:
    """The stamp of a year from those of its months."""
    own = months.where(F.substring("period", 1, 4) == year)
    stamp = _checksum(F.concat_ws(" ", "period", "stamp"))
    return own.groupBy("domain").agg(stamp.alias("stamp")).select(
        "domain", F.lit("year").alias("grain"), F.lit(year).alias("period"), "stamp"
    )


def read_stamps(spark: SparkSession, root: str) -> DataFrame:
    return read_version(spark, f"{root}/{PUBLISHED}", PERIOD_SCHEMA)


def dirty_periods(stamps: DataFrame, known: DataFrame, out: str) -> Dirty:
    """The periods whose stored stamp is another one, or none."""
    keys = ["domain", "grain", "period"]
    stored = known.where(F.col("out") == out).select(*keys, F.col("stamp").alias("stored"))
    found = stamps.join(stored, keys, "left").where(~F.col("stamp").eqNullSafe(F.col("stored")))
    dirty = Dirty()
    for row in found.select(*keys).collect():
        (dirty.years if row["grain"] == "year" else dirty.months).add((row["domain"], row["period"]))
    return dirty


def write_stamps(spark: SparkSession, root: str, stamps: DataFrame, out: str) -> None:
    """Note that periods are published; the stamps of all others stay."""
    keys = ["domain", "grain", "period", "out"]
    new = stamps.withColumn("out", F.lit(out))
    others = read_stamps(spark, root).join(new.select(*keys), keys, "left_anti")
    write_version(spark, f"{root}/{PUBLISHED}", others.unionByName(new), PERIOD_SCHEMA)
