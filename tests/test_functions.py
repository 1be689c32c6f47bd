from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logtide.functions import calendars as cal
from logtide.functions import requests as rq
from logtide.functions import shares
from logtide.functions.urls import url_path


def apply(spark, expression, values, kind="string"):
    frame = spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], f"i int, v {kind}"
    ).select("i", expression(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(frame.collect(), key=lambda r: r["i"])]


BOTS = [("Googlebot-Image", "Images"), ("Googlebot", "Google"), ("bot", "Other")]
AGENTS = {
    "x Googlebot-Image/1": "Images",
    "x Googlebot/2": "Google",
    "a bot": "Other",
    "googlebot": "Other",
    "GOOGLE": None,
    "": None,
    None: None,
}


def test_first_matching_bot_pattern_wins(spark):
    result = apply(spark, lambda c: rq.bot_name(c, BOTS), list(AGENTS))
    assert result == list(AGENTS.values())


def test_grams(spark):
    frame = spark.createDataFrame(
        [("abab", 2), ("abc", 3), ("ab", 3), ("ab", 0), ("", 0), ("", 1)], "t string, n int"
    ).select(rq.grams(F.col("t"), F.col("n")).alias("g"))
    assert [r["g"] for r in frame.collect()] == [["ab", "ba"], ["abc"], [], [""], [""], []]


def test_empty_bot_map(spark):
    assert apply(spark, lambda c: rq.bot_name(c, []), ["Googlebot", None]) == [None, None]


def test_path_category(spark):
    expected = {
        "/": "page",
        "/about": "page",
        "/A.CSS": "css",
        "/x.js": "js",
        "/x.Mjs": "js",
        "/i.jpeg": "image",
        "/i.SVG": "image",
        "/favicon.ico": "image",
        "/f.woff": "font",
        "/f.woff2": "font",
        "/robots.txt": "data",
        "/feed.atom": "data",
        "/a.b/c": "page",
        "/a.css/": "page",
        "/x.": "page",
        "/x.css.map": "page",
        "css": "page",
        ".css": "css",
        "/x.css\n": "page",
        "": "page",
    }
    assert apply(spark, rq.path_category, list(expected)) == list(expected.values())


def test_request_hour(spark):
    expected = {
        "09:30:00": 9,
        "23:59:00": 23,
        "00:00:00": 0,
        "": 0,
        "9": 0,
        "9:00": 0,
        "+9:00:00": 9,
        " 9:00": 0,
        "-1:00": 0,
        "24:00:00": 24,
        "ab:00": 0,
        "1": 0,
        None: 0,
    }
    assert apply(spark, rq.request_hour, list(expected)) == list(expected.values())


def test_referer_host(spark):
    expected = {
        "https://a.com/x/y": "a.com",
        "http://a.com": "a.com",
        "https://a.com?q=1": "a.com?q=1",
        "http://a.com:80/": "a.com:80",
        "HTTPS://a.com/": None,
        "android-app://x": None,
        "https://": "",
        "-": None,
        "": None,
        None: None,
    }
    assert apply(spark, rq.referer_host, list(expected)) == list(expected.values())


def test_external_referer(spark):
    expected = {
        "https://other.com/": True,
        "https://Example.COM/x": False,
        "https://www.example.com/": True,
        "https://example.com:443/": True,
        "https://example.com?q": True,
        "https://": True,
        "ftp://other.com": False,
        "-": False,
        "": False,
        None: False,
    }
    result = apply(spark, lambda c: rq.is_external_referer(c, F.lit("example.com")), list(expected))
    assert result == list(expected.values())


def test_ascii_lower_leaves_other_letters(spark):
    assert apply(spark, rq.ascii_lower, ["AbZ", "K", "É"]) == ["abz", "K", "É"]


def test_hit_needs_exact_method_and_status(spark):
    frame = spark.createDataFrame(
        [("GET", "200"), ("GET", "304"), ("get", "200"), ("GET", "404"), (None, "200"), ("GET", None)],
        "m string, s string",
    ).select(rq.is_hit(F.col("m"), F.col("s")).alias("r"))
    assert [r["r"] for r in frame.collect()] == [True, True, False, False, False, False]


@pytest.mark.parametrize(
    ("total", "bots", "expected"),
    [(0, 0, (100, 0)), (8, 1, (87, 13)), (3, 1, (67, 33)), (10, 20, (0, 100)), (200, 1, (99, 1))],
)
def test_percent_split(spark, total, bots, expected):
    frame = spark.createDataFrame([(total, bots)], "t bigint, b bigint").select(
        shares.human_pct(F.col("t"), F.col("b")), shares.bot_pct(F.col("t"), F.col("b"))
    )
    assert tuple(frame.first()) == expected


def test_estimated_bot_visitors_is_cut(spark):
    frame = spark.createDataFrame([(5, 3, 2), (0, 0, 0)], "v bigint, h bigint, b bigint")
    result = frame.select(
        shares.estimated_bot_visitors(F.col("v"), F.col("h"), F.col("b")).alias("r")
    )
    assert [r["r"] for r in result.collect()] == [3, 0]


def test_parse_date(spark):
    values = ["2026-03-01", "2026-02-30", "2026-3-1", "x", "", None, "2024-02-29"]
    result = apply(spark, cal.parse_date, values)
    assert [str(r) if r else None for r in result] == [
        "2026-03-01", None, None, None, None, None, "2024-02-29",
    ]


def test_month_start_and_days(spark):
    result = apply(spark, cal.month_start, ["2026-03", "2024-2"])
    assert [str(r) for r in result] == ["2026-03-01", "2024-02-01"]
    for wrong in ("2026-13", "2026", "2026-03-01", "202x-01", "2026-257"):
        with pytest.raises(Exception, match="not a YYYY-MM month"):
            apply(spark, cal.month_start, [wrong])


def test_days_stop_at_as_of_and_never_run_backwards(spark):
    frame = spark.range(1).select(
        F.size(cal.days_between("2024-02-01", "2024-02-29")).alias("whole"),
        F.size(cal.days_between("2024-02-01", "2024-02-29", "2024-02-10")).alias("cut"),
        cal.days_between("2024-02-01", "2024-02-29", "2024-01-31").alias("none"),
    )
    assert tuple(frame.first()) == (29, 10, None)


def test_utc_today_does_not_follow_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        days = set()
        for other in ("Pacific/Kiritimati", "Etc/GMT+12", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            days.add(spark.range(1).select(cal.utc_today()).first()[0])
        assert len(days) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_url_path(spark):
    expected = {
        "https://example.com/": "/",
        "https://example.com": "/",
        "https://example.com?q=1": "/",
        "https://example.com/blog?x=1#top": "/blog",
        "https://example.com/a/b.html#c": "/a/b.html",
        "http://user@example.com:8080/p": "/p",
        "/relative": "/relative",
        "not a url": "not a url",
        "https://example.com/café au lait": "/caf%C3%A9%20au%20lait",
        "https://example.com/\U0001f600": "/%F0%9F%98%80",
        "https://example.com/already%20done": "/already%20done",
        'https://example.com/a"b<c>d`e{f}': "/a%22b%3Cc%3Ed%60e%7Bf%7D",
        "https://example.com/a/./b": "/a/b",
        "https://example.com/a/../b": "/b",
        "https://example.com/../../b": "/b",
        "https://example.com/a/b/..": "/a/",
        "https://example.com/a/.": "/a/",
        "https://example.com/a/%2E%2e/b": "/b",
        "https://example.com/a/...": "/a/...",
        "https://example.com/.hidden": "/.hidden",
        # What a browser forgives.
        "  https://example.com/a \n": "/a",
        "\x01https://example.com/a\x1f": "/a",
        "https://exam\tple.com/a\r\n/b": "/a/b",
        "https:/example.com/a": "/a",
        "https:example.com/a": "/a",
        "https:////example.com/a": "/a",
        "HTTPS:\\\\example.com\\a\\..\\b?c\\d": "/b",
        "https://example.com\\": "/",
        "https://[::1]:8080/six": "/six",
        "https://user:word@example.com:/p": "/p",
        "https://example.com:": "/",
        # What it does not.
        "https://": "https://",
        " https:///?q": " https:///?q",
        "https://exa mple.com/a": "https://exa mple.com/a",
        "https://example.com:port/a": "https://example.com:port/a",
        " /relative": " /relative",
        None: None,
    }
    assert apply(spark, url_path, list(expected)) == list(expected.values())
