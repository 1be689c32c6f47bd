"""The report and compaction jobs from raw files to published tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from logtide.functions.calendars import month_range
from logtide.plans import jobs
from logtide.sources.lookups import Site
from tests.logs import BOTS, GOOGLE, log, row, rows_of


def land(spark, folder, rows):
    frame = log(spark, rows).drop("domain", "dt")
    frame.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def sites(spark, tmp_path):
    sitemap = tmp_path / "s.xml"
    entries = "".join(f"<url><loc>https://a.com/{p}</loc></url>" for p in ("", "seen", "never"))
    sitemap.write_text(f"<urlset>{entries}</urlset>")
    land(
        spark,
        tmp_path / "a.com/raw/2026/02/27/05",
        [row("2026-02-27", ip="1"), row("2026-02-27", path="/seen", ip="2", agent=GOOGLE)],
    )
    land(spark, tmp_path / "a.com/raw/2026/03/01/00", [row(ip="1"), row(ip="3", path="/x.css")])
    land(spark, tmp_path / "a.com/raw/2026/03/02/00", [row("2026-03-02", ip="1")])
    land(spark, tmp_path / "b.com/raw/2026/03/01/00", [row(ip="9")])
    return [
        Site("a.com", str(tmp_path / "a.com/raw"), str(sitemap)),
        Site("b.com", str(tmp_path / "b.com/raw")),
    ]


def run(spark, sites, tmp_path, **arguments):
    folders = (str(tmp_path / f) for f in ("compact", "cache", "out"))
    jobs.report(spark, sites, BOTS, *folders, **arguments)
    return lambda name: spark.read.parquet(str(tmp_path / "out" / name))


def test_year_then_month_report(spark, sites, tmp_path):
    as_of = date(2026, 3, 2)
    published = run(spark, sites, tmp_path, year="2026", as_of=as_of)
    assert rows_of(published("year_totals"), "domain", "year", "hits", "visitors") == [
        ("a.com", 2026, 5, 3),
        ("b.com", 2026, 1, 1),
    ]
    # Months up to the current one, with zeros where nothing was logged.
    assert rows_of(published("month_totals"), "domain", "month", "hits", "visitors") == [
        ("a.com", "2026-01", 0, 0),
        ("a.com", "2026-02", 2, 2),
        ("a.com", "2026-03", 3, 2),
        ("b.com", "2026-01", 0, 0),
        ("b.com", "2026-02", 0, 0),
        ("b.com", "2026-03", 1, 1),
    ]
    missing = published("sitemap_gaps").where("month = '2026-02'")
    assert rows_of(missing, "domain", "loc") == [
        ("a.com", "https://a.com/"),
        ("a.com", "https://a.com/never"),
    ]
    panel = published("day_panels").where("dt = '2026-02-27' and domain = 'a.com'")
    assert rows_of(panel, "hits", "visitors", "bot_hits", "est_bot_visitors") == [(2, 2, 1, 1)]

    # A day later the rest of the month is compacted and today has grown.
    jobs.compact(spark, sites, str(tmp_path / "compact"), month="2026-03", as_of=as_of)
    land(
        spark,
        tmp_path / "a.com/raw/2026/03/02/09",
        [row("2026-03-02", path=p, ip="4", agent=GOOGLE) for p in ("/", "/seen", "/never")],
    )
    run(spark, sites, tmp_path, month="2026-03", site="a.com", as_of=as_of)
    assert rows_of(published("month_totals").where("month = '2026-03'"), "domain", "hits") == [
        ("a.com", 6),
        ("b.com", 1),
    ]
    # All of March is crawled now, so its earlier gap rows are gone.
    assert published("sitemap_gaps").where("month = '2026-03'").count() == 0
    assert published("sitemap_gaps").where("month = '2026-02'").count() == 2


def test_no_cache_reads_old_days_again(spark, sites, tmp_path):
    as_of = date(2026, 3, 31)
    published = run(spark, sites, tmp_path, month="2026-03", as_of=as_of)
    land(spark, tmp_path / "a.com/raw/2026/03/01/07", [row(ip="7")])
    a_com = F.col("domain") == "a.com"
    assert rows_of(published("month_totals").where(a_com), "hits") == [(3,)]
    run(spark, sites, tmp_path, month="2026-03", as_of=as_of, no_cache=True)
    assert rows_of(published("month_totals").where(a_com), "hits") == [(4,)]


def test_compaction_job(spark, sites, tmp_path):
    table, as_of = str(tmp_path / "compact"), date(2026, 3, 2)
    plan = jobs.compact(spark, sites, table, year="2026", dry_run=True, as_of=as_of)
    assert rows_of(plan.where("action = 'compact'"), "domain", "dt", "rows") == [
        ("a.com", "2026-02-27", 2),
        ("a.com", "2026-03-01", 2),
        ("b.com", "2026-03-01", 1),
    ]
    done = jobs.compact(spark, sites, table, month="2026-03", site="b.com", as_of=as_of)
    assert rows_of(done, "domain", "dt", "rows", "skipped") == [("b.com", "2026-03-01", 1, False)]


def test_arguments_are_checked(spark, sites, tmp_path):
    with pytest.raises(ValueError, match="month or a year"):
        run(spark, sites, tmp_path)
    with pytest.raises(ValueError, match="not configured"):
        run(spark, sites, tmp_path, month="2026-03", site="c.com")
    for wrong in ("2026-13", "202603", "2026-3-1", "x"):
        with pytest.raises(ValueError):
            month_range(wrong)
    assert month_range("2024-02") == (date(2024, 2, 1), date(2024, 2, 29))
    # A month that has not begun has nothing to report.
    run(spark, sites, tmp_path, month="2026-04", as_of=date(2026, 3, 2))
    assert not (tmp_path / "out").exists()


def _files(tmp_path) -> dict[str, set[str]]:
    """Published files by their partition, such as ``month_pages/domain=a.com/month=2026-03``."""
    found: dict[str, set[str]] = {}
    for file in (tmp_path / "out").rglob("*.parquet"):
        found.setdefault(str(file.parent.relative_to(tmp_path / "out")), set()).add(file.name)
    return found


def test_one_changed_day_writes_one_month_and_one_year_of_one_site(spark, sites, tmp_path):
    as_of = date(2026, 3, 20)
    published = run(spark, sites, tmp_path, year="2026", as_of=as_of)
    before = _files(tmp_path)
    land(spark, tmp_path / "a.com/raw/2026/02/27/11", [row("2026-02-27", ip="1"), row("2026-02-27", ip="8")])
    run(spark, sites, tmp_path, year="2026", as_of=as_of)
    after = _files(tmp_path)
    changed = {p.split("/", 1)[1] for p in before | after if before.get(p) != after.get(p)}
    assert changed == {"domain=a.com/month=2026-02", "domain=a.com/year=2026"}
    assert rows_of(published("year_totals"), "domain", "hits", "visitors") == [("a.com", 7, 4), ("b.com", 1, 1)]
    assert rows_of(published("year_pages").where("path = '/'"), "domain", "hits", "visitors") == [
        ("a.com", 5, 4),
        ("b.com", 1, 1),
    ]
    shares = published("month_shares").where("domain = 'a.com' and month <= '2026-03'")
    assert rows_of(shares, "month", "share_of_max") == [("2026-01", 0.0), ("2026-02", 100.0), ("2026-03", 75.0)]

    # The same files again, and another day of the calendar: today's month and the year.
    run(spark, sites, tmp_path, year="2026", as_of=as_of)
    assert _files(tmp_path) == after
    run(spark, sites, tmp_path, year="2026", as_of=date(2026, 3, 21))
    later = _files(tmp_path)
    changed = {p.split("/")[-1] for p in later if after.get(p) != later.get(p)}
    assert changed == {"month=2026-03", "year=2026"}


def test_a_new_sitemap_writes_the_months_of_its_site(spark, sites, tmp_path):
    published = run(spark, sites, tmp_path, month="2026-03", as_of=date(2026, 3, 20))
    before = _files(tmp_path)
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.com/new</loc></url></urlset>")
    run(spark, sites, tmp_path, month="2026-03", as_of=date(2026, 3, 20))
    after = _files(tmp_path)
    assert {p.split("/")[1] for p in after if after[p] != before.get(p)} == {"domain=a.com"}
    assert rows_of(published("sitemap_gaps"), "loc") == [("https://a.com/new",)]
