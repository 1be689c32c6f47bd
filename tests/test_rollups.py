"""Months, years and ranges, and the rules that tie the reports together."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logtide.functions.requests import path_category
from logtide.operators import calendars, rankings, rollups
from logtide.operators.requests import hits
from logtide.plans import reports
from logtide.sources.lookups import Site, sites_table
from tests.logs import BING, GOOGLE, HUMAN, requests, row, rows_of

FIRST, LAST = "2025-12-30", "2026-02-03"


def random_rows(n=600):
    """A log over three months and two years in which one of everything is hot."""
    rng = random.Random(7)

    def pick(values):
        # A third of all rows fall on the first value.
        return values[0] if rng.random() < 0.33 else rng.choice(values)

    days = ["2026-01-15", "2025-12-30", "2025-12-31", "2026-01-01", "2026-01-31", "2026-02-01"]
    return [
        row(
            date=pick(days),
            time=f"{rng.randrange(24):02d}:00:00",
            ip=pick(["9.9.9.9", None, *[f"1.0.0.{i}" for i in range(40)]]),
            method=pick(["GET", "POST"]),
            path=pick(["/", "/a", "/b.css", "/c.js", "/d.png", "/e.xml"]),
            status=pick(["200", "304", "404"]),
            referer=pick(["https://x.org/1", "https://y.org/", "-", None]),
            agent=pick([HUMAN, GOOGLE, BING, None]),
        )
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def found(spark):
    rows = random_rows()
    one = requests(spark, rows[:400], "a.com")
    return one.unionByName(requests(spark, rows[400:], "b.com")).cache()


@pytest.fixture(scope="module")
def days(spark):
    return calendars.site_days(sites_table(spark, [Site("a.com"), Site("b.com")]), FIRST, LAST)


def by_hand(found, key):
    """(site, period) -> hits, visitors, bot hits, bot visitors in plain Python."""
    counted = {}
    for r in hits(found).collect():
        entry = counted.setdefault((r["domain"], str(r["dt"])[:key]), [0, set(), 0, set()])
        entry[0] += 1
        entry[1].add(r["c_ip"])
        if r["bot_name"]:
            entry[2] += 1
            entry[3].add(r["c_ip"])
    return {k: (h, len(v), b, len(bv)) for k, (h, v, b, bv) in counted.items()}


@pytest.mark.parametrize(("grain", "key"), [("day", 10), ("month", 7), ("year", 4)])
def test_totals_at_each_grain(found, days, grain, key):
    report = reports.traffic_report(found, days, grain)
    name = {"day": "dt", "month": "month", "year": "year"}[grain]
    expected = by_hand(found, key)
    for r in report.collect():
        figures = (r["hits"], r["visitors"], r["bot_hits"], r["bot_visitors"])
        assert figures == expected.get((r["domain"], str(r[name])), (0, 0, 0, 0))
    assert report.count() == {"day": 72, "month": 6, "year": 4}[grain]


def test_stored_figures_give_the_same_totals(found, days):
    daily = reports.traffic_report(found, days)
    visitor_table = rollups.visitor_days(found)
    for grain in ("month", "year"):
        direct = reports.traffic_report(found, days, grain)
        stored = rollups.stored_traffic(daily, grain, visitor_table)
        columns = direct.columns
        assert rows_of(stored, *columns) == rows_of(direct, *columns)


def test_totals_without_a_visitor_table_add_the_days(found, days):
    daily = reports.traffic_report(found, days)
    summed = rollups.stored_traffic(daily, "month")
    for r in summed.collect():
        parts = [
            d for d in daily.collect()
            if d["domain"] == r["domain"] and str(d["dt"])[:7] == r["month"]
        ]
        assert r["visitors"] == sum(d["visitors"] for d in parts)
        assert r["bot_visitors"] == sum(d["bot_visitors"] for d in parts)


def test_visitors_of_a_range(found):
    visitor_table = rollups.visitor_days(found)
    for first, last in [("2025-12-31", "2026-01-15"), ("2026-01-15", "2026-01-15")]:
        inside = hits(found).where(F.col("dt").between(F.lit(first), F.lit(last))).collect()
        for r in rollups.range_visitors(visitor_table, first, last).collect():
            own = [x for x in inside if x["domain"] == r["domain"]]
            assert r["visitors"] == len({x["c_ip"] for x in own})
            assert r["bot_visitors"] == len({x["c_ip"] for x in own if x["bot_name"]})
    assert rollups.range_visitors(visitor_table, "2020-01-01", "2020-02-01").count() == 0


def test_month_pages_add_daily_visitors(found):
    visits = rollups.page_visits(found)
    by_day = rollups.pages(visits, "day")
    for grain in ("month", "year"):
        assert rows_of(rollups.pages(visits, grain)) == rows_of(rollups.pages(by_day, grain))


def test_period_rollups_match_day_rollups(found):
    facts = [
        (rollups.bots, rollups.bot_requests(found)),
        (rollups.crawled_paths, rollups.crawler_hits(found)),
        (rollups.referers, rollups.referred_hits(found)),
    ]
    for rollup, rows in facts:
        assert rows_of(rollup(rows, "year")) == rows_of(rollup(rollup(rows, "day"), "year"))


def test_reports_agree_with_each_other(found, days):
    daily = reports.traffic_report(found, days)

    def hits_per_day(frame):
        total = frame.groupBy("domain", "dt").agg(F.sum("hits").alias("hits")).where("hits > 0")
        return rows_of(total)

    expected = rows_of(daily.select("domain", "dt", "hits").where("hits > 0"))
    assert hits_per_day(rollups.pages(rollups.page_visits(found))) == expected
    assert hits_per_day(reports.hourly_report(found, days)) == expected
    assert hits_per_day(rollups.visitors(found)) == expected
    monthly = reports.traffic_report(found, days, "month").collect()
    for r in monthly:
        parts = [
            d for d in daily.collect()
            if d["domain"] == r["domain"] and str(d["dt"])[:7] == r["month"]
        ]
        assert r["visitors"] <= sum(d["visitors"] for d in parts)


def test_partitioning_does_not_change_results(found, days):
    for other in (found.repartition(1), found.repartition(13, "c_ip")):
        for make in (
            lambda f: reports.traffic_report(f, days, "month"),
            lambda f: rollups.pages(rollups.page_visits(f), "month"),
            lambda f: reports.hourly_report(f, days),
        ):
            assert rows_of(make(other)) == rows_of(make(found))


def test_kpis(found, days):
    report = reports.kpis(
        reports.traffic_report(found, days, "month"),
        rollups.bots(rollups.bot_requests(found), "month"),
        "month",
    )
    totals = by_hand(found, 7)
    for r in report.collect():
        hit_count, visitors, bot_hits, bot_visitors = totals[r["domain"], r["month"]]
        assert (r["hits"], r["visitors"]) == (hit_count, visitors)
        assert r["hits_bot_pct"] == int(bot_hits / hit_count * 100 + 0.5)
        assert r["hits_human_pct"] == 100 - r["hits_bot_pct"]
        assert r["vis_bot_pct"] == int(bot_visitors / visitors * 100 + 0.5)
        assert r["active_bots"] <= 2


def test_top_lists_break_ties_by_name(spark):
    found = requests(spark, [row(path=p) for p in ["/c", "/b", "/a", "/b", "/d.css"]])
    pages = rollups.pages(rollups.page_visits(found), "month")
    top = rankings.top_content_pages(pages, "month", 2)
    assert rows_of(top, "rank", "path", "hits") == [(1, "/b", 2), (2, "/a", 1)]


def test_bars_are_shares_of_the_highest(spark):
    found = requests(
        spark, [row(ip="1"), row(ip="2"), row(date="2026-03-02"), row(date="2026-04-01")]
    )
    days = calendars.site_days(sites_table(spark, [Site("example.com")]), "2026-03-01", "2026-04-02")
    bars = {
        str(r["dt"]): r["share_of_max"]
        for r in reports.daily_shares(reports.traffic_report(found, days)).collect()
    }
    assert bars["2026-03-01"] == 100.0
    assert bars["2026-03-02"] == 50.0
    assert bars["2026-03-03"] == 0.0
    assert bars["2026-04-01"] == 100.0
    monthly = reports.monthly_shares(reports.traffic_report(found, days, "month"))
    assert rows_of(monthly, "month", "share_of_max") == [
        ("2026-03", 100.0),
        ("2026-04", pytest.approx(100 / 3)),
    ]


def test_calendar_of_months(spark):
    months = spark.createDataFrame([("2026-02",), ("2026-03",)], "month string")
    days = calendars.calendar_days(months, as_of="2026-03-02").orderBy("dt").collect()
    assert len(days) == 30
    assert tuple(days[0]) == (days[0]["dt"], 1, "Feb", "Feb 1", 6)
    assert tuple(days[-1])[1:] == (2, "Mar", "Mar 2", 0)
    assert calendars.calendar_days(months, as_of="2026-01-31").count() == 0


def test_day_metrics_round_trip(found, days):
    table = reports.day_metrics(found, days)
    page = reports.day_metric(table, "page")
    assert rows_of(rollups.pages(page, "year")) == rows_of(
        rollups.pages(rollups.page_visits(found), "year")
    )
    tables = reports.period_tables(table, rollups.visitor_days(found), "year")
    direct = reports.traffic_report(found, days, "year")
    assert rows_of(tables["year_totals"], *direct.columns) == rows_of(direct)
    assert rows_of(tables["year_bots"]) == rows_of(
        rollups.bots(rollups.bot_requests(found), "year")
    )
    panels = reports.day_panels(table, days)
    assert rows_of(panels["day_panels"]) == rows_of(
        reports.day_panel(rollups.page_visits(found), days)
    )
    assert panels["day_hours"].count() == 72 * 24


def test_category_depends_on_the_path_alone(found):
    pages = rollups.pages(rollups.page_visits(found))
    again = pages.withColumn("again", path_category(F.col("path")))
    assert again.where("again <> category").count() == 0
