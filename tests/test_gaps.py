"""Sitemaps and the crawl gap report."""

from __future__ import annotations

import logging

from logtide.operators import calendars, gaps, rollups
from logtide.plans import reports
from logtide.sources.lookups import Site, sites_table
from logtide.operators import gaps
from logtide.sources.sitemaps import read_sitemaps, sitemap_problems, unreadable_sitemaps
from tests.logs import GOOGLE, requests, row, rows_of

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def write_sitemap(tmp_path, name, entries):
    file = tmp_path / name
    body = "\n".join(f"<url>{entry}</url>" for entry in entries)
    file.write_text(f"{HEAD}\n<urlset {NAMESPACE}>\n{body}\n</urlset>")
    return str(file)


def locations(urls):
    return [f"\n <loc>{u}</loc>\n <lastmod>2026-01-01</lastmod>\n" for u in urls]


def test_sitemap_entries_in_file_order(spark, tmp_path):
    urls = ["https://example.com/", "https://example.com/blog", "https://example.com/a?x=1&amp;y=2"]
    site = Site("example.com", sitemap=write_sitemap(tmp_path, "s.xml", locations(urls)))
    entries = read_sitemaps(spark, [site]).orderBy("pos").collect()
    assert [e["loc"] for e in entries] == [u.replace("&amp;", "&") for u in urls]
    assert {e["domain"] for e in entries} == {"example.com"}


def test_unusable_sitemaps_give_no_entries(spark, tmp_path, caplog):
    index = tmp_path / "index.xml"
    index.write_text(
        f"{HEAD}<sitemapindex {NAMESPACE}><sitemap><loc>https://e.com/s.xml</loc></sitemap></sitemapindex>"
    )
    broken = write_sitemap(tmp_path, "b.xml", [*locations(["https://e.com/"]), "<lastmod>x</lastmod>"])
    good = write_sitemap(tmp_path, "g.xml", locations(["https://g.com/"]))
    sites = [
        Site("none.com"),
        Site("missing.com", sitemap=str(tmp_path / "nothing.xml")),
        Site("index.com", sitemap=str(index)),
        Site("broken.com", sitemap=broken),
        Site("good.com", sitemap=good),
    ]
    with caplog.at_level(logging.WARNING):
        entries = read_sitemaps(spark, sites)
        assert rows_of(entries, "domain", "loc") == [("good.com", "https://g.com/")]
    assert "missing.com" in caplog.text


def gap_inputs(spark, tmp_path, urls, rows):
    site = Site("example.com", sitemap=write_sitemap(tmp_path, "s.xml", locations(urls)))
    days = calendars.site_days(sites_table(spark, [site]), "2026-02-01", "2026-03-31")
    return requests(spark, rows), read_sitemaps(spark, [site]), days


def test_gaps_per_month(spark, tmp_path):
    urls = [
        "https://example.com",
        "https://example.com/seen#part",
        "https://example.com/posted",
        "https://example.com/bing",
        "https://example.com/never",
        "https://example.com/never",
        "https://example.com/%C3%A9",
        "https://example.com/&#xE9;",
    ]
    rows = [
        row(path="/", agent=GOOGLE),
        row(path="/seen", agent=GOOGLE),
        row(path="/posted", method="POST", agent=GOOGLE),
        row(path="/bing"),
        row(path="/%C3%A9", agent=GOOGLE),
    ]
    found, sitemap, days = gap_inputs(spark, tmp_path, urls, rows)
    report = reports.gap_report(found, sitemap, days).orderBy("month", "pos").collect()
    march = [r["loc"] for r in report if r["month"] == "2026-03"]
    assert march == [
        "https://example.com/posted",
        "https://example.com/bing",
        "https://example.com/never",
        "https://example.com/never",
    ]
    # No crawler came in February, so every entry is missing.
    assert len([r for r in report if r["month"] == "2026-02"]) == len(urls)


def test_gap_summary_counts_the_rest(spark, tmp_path):
    urls = [f"https://example.com/{i}" for i in range(20)]
    found, sitemap, days = gap_inputs(spark, tmp_path, urls, [row(path="/3", agent=GOOGLE)])
    summary = gaps.gap_summary(reports.gap_report(found, sitemap, days), 15)
    march = summary.where("month = '2026-03'").orderBy("pos").collect()
    assert [r["loc"][-2:].strip("/") for r in march] == [str(i) for i in range(16) if i != 3]
    assert {r["more"] for r in march} == {4}
    assert {r["more"] for r in summary.where("month = '2026-02'").collect()} == {5}
    few = gaps.gap_summary(reports.gap_report(found, sitemap, days), 30)
    assert {r["more"] for r in few.collect()} == {0}


def test_gaps_from_stored_day_figures(spark, tmp_path):
    urls = [f"https://example.com/{i}" for i in range(5)]
    found, sitemap, days = gap_inputs(spark, tmp_path, urls, [row(path="/3", agent=GOOGLE)])
    tables = reports.gap_tables(reports.day_metrics(found, days), sitemap, days)
    direct = reports.gap_report(found, sitemap, days)
    assert rows_of(tables["sitemap_gaps"]) == rows_of(direct)
    assert rollups.crawler_hits(found).count() == 1


def test_what_is_wrong_with_sitemaps(spark, tmp_path):
    good = "<urlset><url><loc>https://e.com/</loc></url><url><loc>https://e.com/b</loc></url></urlset>"
    texts = {
        "good": good,
        "cut": good[:-20],
        "gone": "<html>gone</html>",
        "tags": "<html><p>gone<br></html>",
        "text": "not found",
        "blank": " \n",
        "zero": "",
        "bare": "<urlset><url><loc>https://e.com/</loc></url><url><lastmod>x</lastmod></url></urlset>",
        "none": "<urlset></urlset>",
    }
    sites = [Site(f"{name}.com", sitemap=str(tmp_path / f"{name}.xml")) for name in [*texts, "missing"]]
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text)
    sites += [Site("two.com", sitemap=sites[0].sitemap), Site("without.com")]
    assert dict(rows_of(sitemap_problems(spark, sites))) == {
        "cut.com": "not_xml",
        "gone.com": "no_entries",
        "tags.com": "not_xml",
        "text.com": "not_xml",
        "blank.com": "empty",
        "zero.com": "empty",
        "bare.com": "no_location",
        "none.com": "no_entries",
        "missing.com": "missing",
    }
    assert rows_of(read_sitemaps(spark, sites).groupBy("domain").count()) == [("good.com", 2), ("two.com", 2)]
    assert unreadable_sitemaps(spark, sites).count() == 9
    assert rows_of(sitemap_problems(spark, [Site("without.com")])) == []


def test_first_gaps_and_their_number_in_one_pass(spark):
    rows = [("a.com", f"2026-{m:02d}", p, f"u{p}") for m, n in ((1, 3), (2, 500), (3, 15)) for p in range(n)]
    rows += [("a.com", "2026-01", 1, "u1")]
    frame = spark.createDataFrame(rows, "domain string, month string, pos long, loc string")
    missing = frame.join(spark.createDataFrame([("none",)], "loc string"), "loc", "left_anti")
    summary = gaps.gap_summary(missing, 15)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
    found = {}
    for r in summary.orderBy("month", "pos").collect():
        found.setdefault(r.month, []).append((r.pos, r.more))
    assert found == {
        "2026-01": [(0, 0), (1, 0), (1, 0), (2, 0)],
        "2026-02": [(p, 485) for p in range(15)],
        "2026-03": [(p, 0) for p in range(15)],
    }
    assert gaps.gap_summary(missing.limit(0), 15).collect() == []
