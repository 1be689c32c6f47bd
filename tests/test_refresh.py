"""Runs that follow each other: days that grow, runs that end early, bad input."""

from __future__ import annotations

from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logtide.operators import calendars
from logtide.plans import compaction, jobs, refresh, reports, state
from logtide.plans.state import read_state, state_version
from logtide.sources import logs as log_source
from logtide.sources.commits import partition_files
from logtide.sources.lookups import Site, sites_table
from tests.logs import BOTS, GOOGLE, log, row, rows_of

D1, D2, D3, D4 = (date(2026, 3, d) for d in (1, 2, 3, 4))


def land(spark, folder, rows, **extra):
    frame = log(spark, rows).drop("domain", "dt").withColumns({k: F.lit(v) for k, v in extra.items()})
    frame.coalesce(1).write.mode("append").parquet(str(folder))


class Runs:
    """A site's raw folder and the report job on it."""

    def __init__(self, spark, tmp_path, domain="example.com"):
        self.spark, self.tmp = spark, tmp_path
        self.raw = tmp_path / "raw"
        self.sites = [Site(domain, str(self.raw))]

    def land(self, day: int, n: int, hour: int = 0):
        rows = [row(f"2026-03-{day:02d}", ip=f"{day}.{hour}.{i}") for i in range(n)]
        land(self.spark, self.raw / f"2026/03/{day:02d}/{hour:02d}", rows)

    def report(self, as_of: int, **arguments):
        folders = [str(self.tmp / f) for f in ("compact", "cache", "out")]
        jobs.report(
            self.spark, self.sites, BOTS, *folders, month="2026-03", as_of=date(2026, 3, as_of), **arguments
        )
        return self.hits()

    def compact(self, as_of: int):
        jobs.compact(self.spark, self.sites, str(self.tmp / "compact"), month="2026-03", as_of=date(2026, 3, as_of))

    def published(self, name):
        return self.spark.read.parquet(str(self.tmp / "out" / name))

    def hits(self):
        return self.published("month_totals").agg(F.sum("hits")).first()[0]


@pytest.fixture
def runs(spark, tmp_path):
    return Runs(spark, tmp_path)


def test_days_that_grow_between_runs(runs):
    """A part-day is read again once it is over, raw or compacted."""
    runs.land(1, 1)
    runs.land(2, 1)
    assert runs.report(as_of=2) == 2
    runs.land(2, 5, hour=9)
    assert runs.report(as_of=3) == 7
    runs.land(3, 2)
    runs.compact(as_of=4)
    assert runs.report(as_of=4) == 9
    # A file that arrives for a day long over changes its listing.
    runs.land(1, 3, hour=20)
    assert runs.report(as_of=4) == 9  # compacted without it
    jobs.compact(runs.spark, runs.sites, str(runs.tmp / "compact"), month="2026-03", as_of=D4, force=True)
    assert runs.report(as_of=4) == 12


def test_late_file_of_a_raw_day(runs):
    runs.land(1, 1)
    assert runs.report(as_of=3) == 1
    runs.land(1, 4, hour=5)
    assert runs.report(as_of=3) == 5


def test_run_that_finds_nothing_changed_writes_nothing(runs):
    runs.land(1, 2)
    runs.report(as_of=31)
    before = state_version(runs.spark, str(runs.tmp / "cache"))
    files = rows_of(runs.published("month_totals").select(F.input_file_name()))
    # Day 31 is "today"; from the next month on, nothing is planned.
    folders = [str(runs.tmp / f) for f in ("compact", "cache", "out")]
    later = {"month": "2026-03", "as_of": date(2026, 4, 2)}
    jobs.report(runs.spark, runs.sites, BOTS, *folders, **later)
    between = state_version(runs.spark, str(runs.tmp / "cache"))
    assert between > before  # the last day was fetched before it was over
    files = rows_of(runs.published("month_totals").select(F.input_file_name()))
    jobs.report(runs.spark, runs.sites, BOTS, *folders, **later)
    assert state_version(runs.spark, str(runs.tmp / "cache")) == between
    assert rows_of(runs.published("month_totals").select(F.input_file_name())) == files


def test_interrupted_refresh_is_made_up_for(spark, tmp_path, monkeypatch):
    """A run that ends between the log and its figures leaves the days pending."""
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D2)
    refresh.refresh(spark, log(spark, [row()]), wanted, root, BOTS, D3)
    grown = log(spark, [row(ip="1"), row(ip="2")])

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(refresh, "rebuild_tables", stop)
        with pytest.raises(RuntimeError):
            refresh.refresh(spark, grown, wanted, root, BOTS, D3, F.col("dt") == D1)
    assert rows_of(read_state(spark, root), "dt", "pending") == [("2026-03-01", True), ("2026-03-02", False)]
    plan = refresh.refresh(spark, grown, wanted, root, BOTS, D3)
    assert rows_of(plan, "dt", "reason") == [("2026-03-01", "pending")]
    daily = reports.day_metric(refresh.read_day_metrics(spark, root), "traffic")
    assert rows_of(daily, "dt", "hits") == [("2026-03-01", 2), ("2026-03-02", 0)]
    assert refresh.refresh(spark, grown, wanted, root, BOTS, D3).count() == 0


def test_state_is_a_log_of_changes(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com"), Site("idle.org")]), D1, D4)
    refresh.refresh(spark, log(spark, [row()]), wanted, root, BOTS, date(2026, 3, 5))
    known = state_version(spark, root)
    forced = (F.col("dt") == D1) & (F.col("domain") == "example.com")
    refresh.refresh(spark, log(spark, [row()]), wanted, root, BOTS, date(2026, 3, 6), forced)
    written = [spark.read.parquet(f"{root}/sync_state/version={n}") for n in (known + 1, known + 2)]
    for rows, pending in zip(written, (True, False), strict=True):
        assert rows_of(rows, "domain", "dt", "pending") == [("example.com", "2026-03-01", pending)]
    assert read_state(spark, root).count() == 8
    # Written together under the number of the last change; what came before the
    # whole before it goes.
    monkeypatch.setattr(state, "MERGE_AFTER", 2)
    before = rows_of(read_state(spark, root))
    for n in range(1, 5):
        state.write_changes(spark, root, read_state(spark, root).where(F.col("dt") == D1))
        assert rows_of(read_state(spark, root)) == before
        assert state_version(spark, root) == known + 2 + n
    folders = {p.name for p in (tmp_path / "tables/sync_state/whole").iterdir()}
    assert folders == {f"version={known + 3}", f"version={known + 5}"}
    changes = {p.name for p in (tmp_path / "tables/sync_state").glob("version=*")}
    assert changes == {f"version={known + n}" for n in (4, 5, 6)}


def test_whole_state_that_was_not_finished_does_not_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D2)
    monkeypatch.setattr(state, "MERGE_AFTER", 1)
    refresh.refresh(spark, log(spark, [row()]), wanted, root, BOTS, D3)
    before = rows_of(read_state(spark, root))
    number = state_version(spark, root)
    (tmp_path / f"tables/sync_state/whole/version={number}/_SUCCESS").unlink()
    assert rows_of(read_state(spark, root)) == before


def test_idle_days_are_not_rebuilt(spark, tmp_path):
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D3)
    refresh.refresh(spark, log(spark, [row()]), wanted, root, BOTS, D4)
    version = state_version(spark, root)
    assert refresh.lost_days(spark, wanted, root).count() == 0
    refresh.refresh(spark, log(spark, [row()]), wanted, root, BOTS, D4)
    assert state_version(spark, root) == version


def test_site_with_a_port_is_replaced(spark, tmp_path):
    runs = Runs(spark, tmp_path, "localhost:8080")
    runs.land(1, 2)
    assert runs.report(as_of=4) == 2
    for file in runs.raw.rglob("*.parquet"):
        file.unlink()
    assert runs.report(as_of=4, no_cache=True) == 0
    assert not list((tmp_path / "out/month_pages").rglob("*.parquet"))


def test_bad_raw_files_do_not_stop_a_site(spark, tmp_path):
    runs = Runs(spark, tmp_path)
    runs.land(1, 2)
    (runs.raw / "2026/03/01/00/empty.parquet").write_bytes(b"")
    (runs.raw / "2026/03/01/00/short.parquet").write_bytes(b"PAR1 PAR1")
    (runs.raw / "2026/03/02/00").mkdir(parents=True)
    (runs.raw / "2026/03/02/00/tiny.parquet").write_bytes(b"PAR1")
    assert runs.report(as_of=4) == 2
    quality = runs.published("data_quality")
    assert rows_of(quality, "tiny_files", "stray_date_rows", "unreadable_sitemaps") == [(2, 0, 0)]
    runs.compact(as_of=4)
    assert rows_of(partition_files(spark, str(tmp_path / "compact")), "dt") == [("2026-03-01",)]
    assert runs.report(as_of=4) == 2


def test_sites_of_different_types_compact_together(spark, tmp_path):
    land(spark, tmp_path / "a/2026/03/01/00", [row()], sc_bytes=5)
    land(spark, tmp_path / "b/2026/03/01/00", [row()], sc_bytes="6", only_b="x")
    land(spark, tmp_path / "c/2026/03/01/00", [row()], sc_bytes=7)
    land(spark, tmp_path / "c/2026/03/02/00", [row("2026-03-02")], sc_bytes="8")
    sites = [Site(f"{n}.com", str(tmp_path / n)) for n in "abc"] + [Site("d.com")]
    table = str(tmp_path / "compact")
    summary = jobs.compact(spark, sites, table, month="2026-03", as_of=D3)
    assert rows_of(summary.where("not skipped"), "domain", "dt", "rows") == [
        ("a.com", "2026-03-01", 1),
        ("b.com", "2026-03-01", 1),
        ("c.com", "2026-03-01", 1),
        ("c.com", "2026-03-02", 1),
    ]
    stored = spark.read.option("mergeSchema", "true").parquet(table)
    assert rows_of(stored, "domain", "sc_bytes", "only_b") == [
        ("a.com", "5", None),
        ("b.com", "6", "x"),
        ("c.com", "7", None),
        ("c.com", "8", None),
    ]
    totals = compaction.run_totals(summary)
    assert rows_of(totals, "domain", "compacted_days", "rows") == [
        ("a.com", 1, 1),
        ("b.com", 1, 1),
        ("c.com", 2, 2),
        ("d.com", 0, 0),
    ]


def test_sites_without_a_raw_log_and_compaction_next_to_it(spark, tmp_path):
    land(spark, tmp_path / "a.com/raw/2026/03/01/00", [row()])
    sites = [Site("a.com", str(tmp_path / "a.com/raw")), Site("b.com")]
    done = jobs.compact(spark, sites, month="2026-03", as_of=D2)
    assert rows_of(done, "domain", "dt", "rows") == [("a.com", "2026-03-01", 1)]
    assert log_source.read_narrow(spark, str(tmp_path / "a.com/compact")).count() == 1


def test_files_of_a_large_day_follow_each_other(spark, tmp_path):
    table, size = str(tmp_path / "compact"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = (
        spark.range(0, 60_000, numPartitions=8)
        .select(
            # Not a literal, which the planner would take out of the order.
            F.when(F.col("id") >= 0, "hot.com").alias("domain"),
            F.expr("date'2026-03-01' + cast(id % 50 = 0 as int)").alias("dt"),
            F.lit("2026-03-01").alias("date"),
            F.when(F.col("id") % 3 > 0, "200").alias("sc_status"),
            F.md5(F.col("id").cast("string")).alias("cs_uri_stem"),
        )
        .withColumns({c: F.lit("x") for c in ("time", "c_ip", "cs_method", "cs_Referer", "cs_User_Agent")})
    )
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, "1m")
        compaction.sort_and_write(rows, table)
    finally:
        spark.conf.set(size, old)
    found = {str(r.dt): r for r in compaction.file_order(spark, table).collect()}
    assert found["2026-03-01"].files > 3
    assert {r.overlapping_files for r in found.values()} == {0}
    assert sum(r.rows for r in found.values()) == 60_000
    for file in (tmp_path / "compact").glob("domain=*/**/*.parquet"):
        stored = pq.read_table(file, partitioning=None).to_pylist()
        keys = [(r["sc_status"] or "", r["cs_uri_stem"]) for r in stored]
        assert keys == sorted(keys)


def test_month_of_another_year_is_reported_too(runs):
    runs.land(1, 2)
    folders = [str(runs.tmp / f) for f in ("compact", "cache", "out")]
    jobs.report(
        runs.spark, runs.sites, BOTS, *folders, month="2026-03", year="2025", as_of=date(2026, 4, 1)
    )
    totals = runs.published("month_totals")
    assert rows_of(totals.where("hits > 0"), "month", "hits") == [("2026-03", 2)]
    assert totals.where("month like '2025-%'").count() == 12
    assert rows_of(runs.published("years"), "year", "is_current") == [(2025, True)]
    daily = runs.published("daily_traffic").where("hits > 0")
    assert rows_of(daily, "dt", "hits", "visitors") == [("2026-03-01", 2, 2)]
    assert runs.published("daily_shares").count() == 365 + 31


def test_rows_left_out_are_counted(spark, tmp_path):
    runs = Runs(spark, tmp_path)
    sitemap = tmp_path / "s.xml"
    sitemap.write_text("<urlset><url><loc>https://example.com/</loc></url><url><x>1</x></url></urlset>")
    runs.sites = [Site("example.com", str(runs.raw), str(sitemap)), Site("b.com", None, str(tmp_path / "none.xml"))]
    rows = [row(time="25:00:00"), row("2026-03-09"), row(ip=None), row(agent=None), row(agent=GOOGLE)]
    land(spark, runs.raw / "2026/03/01/00", rows)
    runs.report(as_of=4)
    names = ["stray_date_rows", "bad_hour_rows", "null_ip_rows", "null_ua_rows", "tiny_files", "unreadable_sitemaps"]
    assert rows_of(runs.published("data_quality"), "domain", *names) == [
        ("b.com", 0, 0, 0, 0, 0, 1),
        ("example.com", 1, 1, 1, 1, 0, 1),
    ]


def test_failed_publication_leaves_the_earlier_one(runs, monkeypatch):
    runs.land(1, 2)
    runs.report(as_of=3)
    runs.land(1, 1, hour=5)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(reports, "publish", stop)
        with pytest.raises(RuntimeError):
            runs.report(as_of=3)
    assert runs.hits() == 2
    assert runs.report(as_of=3) == 3


def test_report_leaves_no_scratch(spark, runs):
    runs.land(1, 1)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    from pathlib import Path

    before = set(Path(shared).iterdir())
    runs.report(as_of=3)
    assert set(Path(shared).iterdir()) == before


def test_listing_looks_only_at_the_range(spark, tmp_path):
    table = str(tmp_path / "compact")
    for day in ("2026-02-01", "2026-03-01"):
        frame = log(spark, [row(day)], day=day)
        compaction.sort_and_write(frame, table)
    compaction.sort_and_write(log(spark, [row()], domain="b.com"), table)
    plan = partition_files(spark, table, ["example.com"], D1, D2)
    assert len([f for f in plan.inputFiles() if "/dt=" in f]) == 1
    assert len(log_source.read_narrow(spark, table, D1, D2, ["example.com"]).inputFiles()) == 1
