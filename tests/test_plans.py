"""Plans that must hold at scale: pushdown, pruning, cut-off top lists, no pair joins."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from logtide import queries as catalogue
from logtide.operators import rankings, rollups
from logtide.operators.calendars import log_months
from logtide.operators.requests import classify
from logtide.plans import refresh
from logtide.schema import DAY_KEYS
from logtide.sources.event_log import access_log
from logtide.sources.logs import read_narrow
from tests.logs import BOTS, GOOGLE, log, row

SF_DIR = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def read_columns(plan: str) -> set[str]:
    return {
        column.split(":")[0]
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        for column in schema.split(",")
        if column
    }


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    refresh.write_narrow(log(spark, [row(), row("2026-03-02", agent=GOOGLE)]), root)
    return read_narrow(spark, f"{root}/{refresh.NARROW}")


def test_hit_filter_reaches_the_scan(stored):
    plan = plan_of(rollups.traffic(classify(stored, BOTS), "month"))
    assert "EqualNullSafe(cs_method,GET)" in plan
    assert "EqualNullSafe(sc_status,200)" in plan


def test_scans_read_only_needed_columns(stored):
    requests = classify(stored, BOTS)
    base = {"date", "cs_method", "sc_status", "cs_User_Agent"}
    assert read_columns(plan_of(rollups.traffic(requests))) == base | {"c_ip"}
    assert read_columns(plan_of(rollups.pages(rollups.page_visits(requests)))) == base | {
        "c_ip",
        "cs_uri_stem",
    }
    # Bot activity counts all requests, so it must not filter by hit.
    plan = plan_of(rollups.bots(rollups.bot_requests(requests)))
    assert read_columns(plan) == {"date", "cs_User_Agent"}


def test_month_totals_do_not_pass_through_days(stored):
    """Two shuffles: one to an address per month, one to the month."""
    plan = plan_of(rollups.traffic(classify(stored, BOTS), "month"))
    assert plan.count("Exchange hashpartitioning") == 2
    month_pages = plan_of(rollups.pages(rollups.page_visits(classify(stored, BOTS)), "month"))
    assert month_pages.count("Exchange hashpartitioning") == 2


def test_top_lists_are_cut_before_their_shuffle(stored):
    pages = rollups.pages(rollups.page_visits(classify(stored, BOTS)), "month")
    plan = plan_of(rankings.top_content_pages(pages, "month", 15))
    assert plan.count("WindowGroupLimit") == 2


def test_refresh_reads_only_the_days_of_its_plan(spark, stored):
    days = F.broadcast(stored.select(*DAY_KEYS).where("dt = '2026-03-02'").distinct())
    plan = plan_of(stored.join(days, DAY_KEYS, "left_semi"))
    assert "dynamicpruning" in plan


def test_daily_calendar_bounds_skip_the_page_join(spark):
    first, last = log_months(access_log(spark, SF_DIR))
    plan = plan_of(spark.range(1).select(first, last))
    assert "Join" not in plan


WRITING = {
    "access_log_narrow",
    "visitor_days",
    "sync_plan",
    "refreshed_log",
    "refreshed_month_totals",
    "compaction_plan",
    "compacted_log",
    "compaction_summary",
    "available_years",
    "unique_visitors_range",
    "bitmap_visitors_range",
    "bitmap_year_totals",
    "late_rows_month_totals",
    "interrupted_refresh_totals",
    "compacted_day_order",
    "compaction_totals",
    "published_reports",
    "sitemap_entries",
}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - WRITING))
def test_no_query_pairs_rows(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_gap_report_joins_on_equal_keys(spark):
    assert "LeftAnti" in plan_of(catalogue.queries()["sitemap_gaps"](spark, SF_DIR))
