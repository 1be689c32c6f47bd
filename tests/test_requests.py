"""Day figures of small logs, with results worked out by hand."""

from __future__ import annotations

from logtide.operators import calendars, rankings, rollups
from logtide.operators.requests import bot_dimension, classify, data_quality
from logtide.plans import reports
from logtide.sources.lookups import Site, bots_table, sites_table
from tests.logs import BING, BOTS, DAY, GOOGLE, log, requests, row, rows_of


def one_site_days(spark, first=DAY, last=DAY, domain="example.com"):
    return calendars.site_days(sites_table(spark, [Site(domain)]), first, last)


def daily(spark, found, first=DAY, last=DAY):
    report = reports.traffic_report(found, one_site_days(spark, first, last))
    return rows_of(report, "dt", "hits", "visitors", "bot_hits", "bot_visitors")


def test_hits_are_get_200_304_of_the_day(spark):
    found = requests(
        spark,
        [
            row(time="10:30:00", ip="1.2.3.4"),
            row(time="10:31:00", ip="1.2.3.5", path="/about"),
            row(time="10:32:00", ip="1.2.3.4", status="304"),
            row(ip="1.2.3.6", method="POST", path="/submit"),
            row(ip="1.2.3.7", path="/missing", status="404"),
            row(date="2026-03-02", ip="1.2.3.8"),
        ],
        day=DAY,
    )
    assert daily(spark, found) == [(DAY, 3, 2, 0, 0)]
    assert rollups.visitor_days(found).count() == 2


def test_bots(spark):
    found = requests(
        spark,
        [
            row(ip="1.1.1.1"),
            row(ip="2.2.2.2", path="/articles/rust", agent=GOOGLE),
            row(ip="3.3.3.3", path="/about", agent=BING),
            row(ip="2.2.2.2", method="POST", path="/submit", agent=GOOGLE),
        ],
    )
    assert daily(spark, found) == [(DAY, 3, 3, 2, 2)]
    bots = rollups.bots(rollups.bot_requests(found))
    assert rows_of(bots, "bot_name", "hits", "last_crawl") == [("Bing", 1, DAY), ("Google", 2, DAY)]
    crawled = rollups.crawled_paths(rollups.crawler_hits(found))
    assert rows_of(crawled, "path", "hits") == [("/articles/rust", 1)]
    assert rows_of(rollups.visitor_days(found), "c_ip", "is_bot") == [
        ("1.1.1.1", False),
        ("2.2.2.2", True),
        ("3.3.3.3", True),
    ]


def test_address_is_a_bot_if_one_hit_was(spark):
    found = requests(spark, [row(), row(agent=GOOGLE), row(ip="2", method="POST", agent=GOOGLE)])
    assert daily(spark, found) == [(DAY, 2, 1, 1, 1)]


def test_hours(spark):
    found = requests(
        spark,
        [
            row(time="09:00:00", ip="1"),
            row(time="09:30:00", ip="2"),
            row(time="14:00:00", ip="3"),
            row(time="23:59:00", ip="4"),
            row(time="24:00:00", ip="5"),
        ],
    )
    report = reports.hourly_report(found, one_site_days(spark))
    by_hour = {r["hour"]: (r["hits"], r["visitors"]) for r in report.collect()}
    assert len(by_hour) == 24
    assert by_hour[9] == (2, 2)
    assert by_hour[14] == by_hour[23] == (1, 1)
    assert by_hour[0] == (0, 0)
    # The impossible hour stays in the day and shows in the quality report.
    assert daily(spark, found) == [(DAY, 5, 5, 0, 0)]


def test_pages(spark):
    found = requests(
        spark,
        [
            row(path="/articles/rust-tips", ip="1"),
            row(path="/articles/rust-tips", ip="2"),
            row(path="/static/css/main.css", ip="1"),
            row(path="/static/css/code.css", ip="1"),
            row(path="/about", ip="1"),
            row(path="/robots.txt", ip="1"),
        ],
    )
    pages = rollups.pages(rollups.page_visits(found))
    assert rows_of(pages, "category", "path", "hits", "visitors") == [
        ("css", "/static/css/code.css", 1, 1),
        ("css", "/static/css/main.css", 1, 1),
        ("data", "/robots.txt", 1, 1),
        ("page", "/about", 1, 1),
        ("page", "/articles/rust-tips", 2, 2),
    ]
    top = rankings.top_content_pages(pages, "day", 1)
    assert rows_of(top, "rank", "path") == [(1, "/articles/rust-tips")]
    assets = rankings.static_assets(pages, "day").collect()
    assert [r["path"] for r in assets] == [
        "/static/css/code.css",
        "/static/css/main.css",
        "/robots.txt",
    ]


def test_files_of_a_day_count_as_one(spark, tmp_path):
    first = [row(ip="1.1.1.1"), row(ip="1.1.1.2", path="/about")]
    second = [row(ip="2.2.2.2", agent=GOOGLE), row(ip="1.1.1.1", path="/contact")]
    for rows in (first, second):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert len(stored.inputFiles()) == 2
    assert daily(spark, classify(stored, BOTS)) == [(DAY, 4, 3, 1, 1)]
    assert daily(spark, requests(spark, first + second)) == [(DAY, 4, 3, 1, 1)]


def test_days_come_in_order_with_zeros(spark):
    found = requests(
        spark,
        [
            row(ip="1"),
            row(ip="2", path="/about"),
            row(ip="3"),
            row(date="2026-03-03", ip="4", agent=GOOGLE),
        ],
    )
    assert daily(spark, found, DAY, "2026-03-03") == [
        (DAY, 3, 3, 0, 0),
        ("2026-03-02", 0, 0, 0, 0),
        ("2026-03-03", 1, 1, 1, 1),
    ]


def test_empty_log_gives_a_zero_day(spark):
    found = requests(spark, [])
    assert daily(spark, found) == [(DAY, 0, 0, 0, 0)]
    assert rollups.visitor_days(found).count() == 0
    panel = reports.day_panel(rollups.page_visits(found), one_site_days(spark))
    assert rows_of(panel, "hits", "est_bot_visitors", "hits_human_pct", "vis_bot_pct") == [
        (0, 0, 100, 0)
    ]


def test_external_referers(spark):
    search = "https://search.example.com/find?q=test"
    item = "https://news.example.org/item?id=123"
    found = requests(
        spark,
        [
            row(referer=search),
            row(referer=search, path="/about"),
            row(referer=item),
            row(referer="https://dev.example.net/articles/rust"),
            row(referer="https://DEV.example.net/"),
            row(referer="-"),
            row(referer=""),
            row(referer=None),
            row(referer=search, method="POST"),
        ],
        domain="dev.example.net",
    )
    found = rollups.referers(rollups.referred_hits(found))
    top = rankings.top_by_hits(found, "day", "referer", 15)
    assert rows_of(top, "rank", "referer", "hits") == [(1, search, 2), (2, item, 1)]


def test_missing_values(spark):
    rows = [
        row(ip=None),
        row(ip=None, path=None),
        row(ip="", agent=None),
        row(ip="9", agent=""),
        row(time=None),
        row(method=None),
        row(status=None),
    ]
    found = requests(spark, rows)
    # A missing address and an empty one are the same single visitor.
    assert daily(spark, found) == [(DAY, 5, 3, 0, 0)]
    pages = rollups.pages(rollups.page_visits(found))
    assert rows_of(pages, "path", "hits", "visitors") == [("", 1, 1), ("/", 4, 3)]
    quality = data_quality(log(spark, [*rows, row(time="24:00:00")]))
    assert rows_of(quality) == [("example.com", 0, 1, 2, 1)]


def test_bot_table_in_place_of_the_list(spark):
    overlapping = [("Googlebot-Image", "Images"), ("Googlebot", "Google")]
    rows = [row(agent="Googlebot-Image/1"), row(agent="Googlebot/2"), row(agent=None), row(agent="")]
    table = bots_table(spark, overlapping)
    dimension = bot_dimension(log(spark, rows), table)
    assert rows_of(dimension) == [
        ("", None),
        ("Googlebot-Image/1", "Images"),
        ("Googlebot/2", "Google"),
    ]
    by_table = classify(log(spark, rows), table)
    by_list = classify(log(spark, rows), overlapping)
    assert rows_of(by_table) == rows_of(by_list)


def test_long_bot_list_is_looked_up(spark):
    bots = [(f"crawler-{i:04d}", f"C{i}") for i in range(5000)]
    bots[10:10] = [("ab", "short"), ("Mozilla/5.0 (x; Zbot", "long"), ("crawler-0003 beta", "late"), ("é", "one")]
    agents = [
        "crawler-4999/1", "x crawler-0003 beta", "crawler-000", "cab", "a", "é", "Mozilla/5.0 (x; Zbot)",
        "Mozilla/5.0 (x; Ybot)", "crawler-0020 crawler-0010", "", None, "crawler-4999/1",
    ]
    rows = [row(agent=agent) for agent in agents]
    first = {a: next((n for p, n in bots if a and p in a), None) for a in agents if a is not None}
    dimension = bot_dimension(log(spark, rows), bots_table(spark, bots))
    assert {r["ua"]: r["bot_name"] for r in dimension.collect()} == first
    classified = classify(log(spark, rows), bots)
    expected = [first.get(a) for a in agents]
    assert sorted(map(str, expected)) == sorted(str(r["bot_name"]) for r in classified.collect())
    plan = classified._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "filter(" not in plan


def test_bot_tables_at_their_ends(spark):
    rows = [row(agent="any"), row(agent="")]
    schema = "priority int, pattern string, bot_name string"
    empty = spark.createDataFrame([], schema)
    assert rows_of(bot_dimension(log(spark, rows), empty)) == [("", None), ("any", None)]
    # A pattern without characters is in every agent that has some.
    entries = [(0, None, "nobody"), (1, "", "anybody"), (0, "nyx", "other")]
    odd = spark.createDataFrame(entries, schema)
    assert rows_of(bot_dimension(log(spark, rows), odd)) == [("", None), ("any", "anybody")]


def test_sites_do_not_mix(spark):
    both = log(spark, [row(), row(ip="2")]).unionByName(log(spark, [row()], "other.org"))
    days = calendars.site_days(sites_table(spark, [Site("example.com"), Site("other.org")]), DAY, DAY)
    report = reports.traffic_report(classify(both, BOTS), days)
    assert rows_of(report, "domain", "hits", "visitors") == [
        ("example.com", 2, 2),
        ("other.org", 1, 1),
    ]
