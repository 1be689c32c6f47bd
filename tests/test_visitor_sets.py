"""Exact visitors from bitmaps against the visitor rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.operators import rollups
from logtide.plans import visitor_sets
from tests.logs import rows_of

FIRST = date(2025, 12, 20)
SCHEMA = "domain string, dt date, c_ip string, is_bot boolean"


def drawn(seed: int) -> list[tuple]:
    """Visitor rows of 30 days; some addresses are at both sites, one is empty, one is a bot on one day."""
    draw = random.Random(seed)
    rows = {}
    for day in range(30):
        for site, n in (("a.com", 60), ("b.com", 5)):
            for _ in range(n):
                address = draw.choice(["", *(str(i) for i in range(150))])
                rows[site, FIRST + timedelta(days=day), address] = draw.random() < 0.1
        rows["a.com", FIRST + timedelta(days=day), "turncoat"] = day == 17
    return [(*key, bot) for key, bot in rows.items()]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The rows, and a root that got them in two runs, the second with days of the first."""
    root = str(tmp_path_factory.mktemp("sets"))
    table = spark.createDataFrame(drawn(5), SCHEMA)
    visitor_sets.write_days(spark, root, table.where(F.col("dt") < FIRST + timedelta(days=12)))
    before = rows_of(visitor_sets.read_numbers(spark, root))
    visitor_sets.write_days(spark, root, table.where(F.col("dt") >= FIRST + timedelta(days=10)))
    return table, root, before


def test_numbers_stay_and_have_no_gaps(spark, stored):
    table, root, before = stored
    after = rows_of(visitor_sets.read_numbers(spark, root), "domain", "c_ip", "number")
    assert set(before) < set(after)
    for site in ("a.com", "b.com"):
        own = [r for r in after if r[0] == site]
        assert sorted(r[2] for r in own) == list(range(1, len(own) + 1))
        assert {r[1] for r in own} == {r["c_ip"] for r in table.where(F.col("domain") == site).collect()}


def test_ranges_and_periods_equal_the_visitor_rows(spark, stored):
    table, root, _ = stored
    columns = ["domain", "visitors", "bot_visitors"]
    for first, last in ((0, 29), (9, 14), (17, 17), (18, 29)):
        first, last = (FIRST + timedelta(days=n) for n in (first, last))
        found = visitor_sets.range_visitors(visitor_sets.read_days(spark, root, first, last))
        assert rows_of(found, *columns) == rows_of(rollups.range_visitors(table, first, last), *columns)
    days = visitor_sets.read_days(spark, root)
    months = visitor_sets.merged(days, "month").withColumn("dt", F.to_date(F.concat("month", F.lit("-01"))))
    expected = {g: rows_of(rollups.period_visitors(table, g)) for g in ("month", "year")}
    assert rows_of(visitor_sets.period_visitors(days, "month")) == expected["month"]
    assert rows_of(visitor_sets.period_visitors(days, "year")) == expected["year"]
    assert rows_of(visitor_sets.period_visitors(months, "year")) == expected["year"]


def test_addresses_beyond_one_block(spark, tmp_path):
    """Numbers on both sides of a block's end, for two days that share some of them."""
    root = str(tmp_path)
    rows = spark.range(70_000).select(
        F.lit("a.com").alias("domain"),
        F.when(F.col("id") < 40_000, F.lit(FIRST)).otherwise(F.lit(FIRST + timedelta(days=1))).alias("dt"),
        F.pmod("id", F.lit(50_000)).cast("string").alias("c_ip"),
        (F.col("id") % 7 == 0).alias("is_bot"),
    )
    visitor_sets.write_days(spark, root, rows)
    sets = visitor_sets.read_days(spark, root)
    assert {r["block"] for r in sets.select("block").collect()} == {1, 2}
    assert rows_of(visitor_sets.range_visitors(sets)) == rows_of(
        rollups.range_visitors(rows, FIRST, FIRST + timedelta(days=1)), "domain", "visitors", "bot_visitors"
    )


def test_run_that_ends_early_gives_no_numbers(spark, tmp_path):
    root = str(tmp_path)
    table = spark.createDataFrame(drawn(6), SCHEMA)
    visitor_sets.number_addresses(spark, root, table)
    (tmp_path / visitor_sets.NUMBERS / "version=1" / "_SUCCESS").unlink()
    assert visitor_sets.read_numbers(spark, root).isEmpty()
    visitor_sets.write_days(spark, root, table)
    found = visitor_sets.range_visitors(visitor_sets.read_days(spark, root))
    last = FIRST + timedelta(days=29)
    assert rows_of(found) == rows_of(rollups.range_visitors(table, FIRST, last))


def test_nothing_stored_and_no_rows(spark, tmp_path):
    root = str(tmp_path)
    assert visitor_sets.range_visitors(visitor_sets.read_days(spark, root)).isEmpty()
    visitor_sets.write_days(spark, root, spark.createDataFrame([], SCHEMA))
    assert visitor_sets.read_numbers(spark, root).isEmpty()
    assert visitor_sets.read_days(spark, root).isEmpty()


def test_bitmaps_are_made_behind_one_shuffle_of_numbers(spark, stored):
    """No half-empty bitmap of a task is shuffled: rows are dealt by block, then aggregated."""
    table, root, _ = stored
    plan = visitor_sets.day_sets(table, visitor_sets.read_numbers(spark, root))
    text = plan._jdf.queryExecution().executedPlan().toString()
    top = text.split("REPARTITION_BY_COL")[0]
    assert "bitmap_construct_agg" in top and "ENSURE_REQUIREMENTS" not in top
