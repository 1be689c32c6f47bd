"""Raw folders, compaction, incremental refresh and published tables."""

from __future__ import annotations

from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logtide.operators import calendars, rollups
from logtide.operators.requests import classify
from logtide.plans import compaction, refresh, reports
from logtide.schema import DAY_KEYS, NARROW_COLUMNS
from logtide.sources import logs as log_source
from logtide.sources.commits import partition_days, partition_files
from logtide.sources.lookups import Site, select_sites, sites_table
from logtide.sources import storage
from logtide.sources.storage import (
    broadcast_if_small,
    drop_partitions,
    fresh_folder,
)
from tests.logs import BOTS, GOOGLE, log, row, rows_of

D1, D2, D3, D4 = (date(2026, 3, d) for d in (1, 2, 3, 4))


def land(spark, folder, rows, **extra):
    """One raw file in a delivery folder."""
    frame = log(spark, rows).drop("domain", "dt")
    for name, value in extra.items():
        frame = frame.withColumn(name, F.lit(value))
    frame.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def site(spark, tmp_path):
    """Two days of raw files in hour folders, one in the Hive style, and a stray row."""
    raw = tmp_path / "example.com" / "raw"
    land(spark, raw / "2026/03/01/00", [row(time="00:10:00", ip="1"), row(time="00:05:00", ip="2")])
    land(spark, raw / "2026/03/01/13", [row(time="13:00:00", path="/a.css", ip="1")])
    land(
        spark,
        raw / "year=2026/month=03/day=02/hour=01",
        [row("2026-03-02", agent=GOOGLE), row("2026-03-01", time="23:59:59", ip="late")],
        x_edge_location="FRA2",
    )
    land(spark, raw / "2026/03/04", [row("2026-03-04")])
    return Site("example.com", str(raw))


def test_compact_path():
    assert log_source.compact_path("logs/example.com/raw") == "logs/example.com/compact"
    assert log_source.compact_path("logs/example.com/raw/") == "logs/example.com/compact"
    assert log_source.compact_path("logs/example.com") == "logs/example.com/compact"
    assert log_source.compact_path("s3a://bucket/rawlogs//") == "s3a://bucket/rawlogs/compact"


def test_unknown_site_names_the_known_ones():
    sites = [Site("a.com"), Site("b.com")]
    assert select_sites(sites, "b.com") == [Site("b.com")]
    assert select_sites(sites) == sites
    with pytest.raises(ValueError, match=r"c\.com.*a\.com, b\.com"):
        select_sites(sites, "c.com")


def test_raw_folders_of_a_range(spark, site):
    found = log_source.raw_day_folders(spark, [site], D1, D4)
    assert sorted(f.dt for f in found) == [D1, D2, D4]
    assert [f.dt for f in log_source.raw_day_folders(spark, [site], D2, D3)] == [D2]
    assert log_source.raw_day_folders(spark, [site], date(2025, 1, 1), date(2025, 2, 1)) == []


def test_folder_names_may_hold_spaces(spark, tmp_path):
    raw = tmp_path / "my logs é" / "raw"
    land(spark, raw / "2026/03/01", [row()])
    folders = log_source.raw_day_folders(spark, [Site("example.com", str(raw))], D1, D1)
    assert rows_of(log_source.read_raw(spark, folders), "domain", "dt") == [
        ("example.com", "2026-03-01")
    ]
    assert log_source.raw_files(spark, folders).count() == 1


def test_row_groups_are_limited(spark, tmp_path):
    rows = spark.range(0, 1_100_000, numPartitions=8).select(
        F.lit("big.com").alias("domain"),
        F.lit(D1).alias("dt"),
        (F.col("id") % 100).cast("string").alias("sc_status"),
    )
    compaction.sort_and_write(rows, str(tmp_path / "compact"))
    groups = [
        parquet.metadata.row_group(i).num_rows
        for file in (tmp_path / "compact").rglob("dt=*/*.parquet")
        for parquet in [pq.ParquetFile(file)]
        for i in range(parquet.num_row_groups)
    ]
    assert sum(groups) == 1_100_000
    assert max(groups) <= 1_048_576


def test_plan_reports_files_bytes_and_rows(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    plan = compaction.compaction_plan(spark, [site], table, D1, D4, as_of=D4)
    # The day as_of is still being written and is left out.
    assert rows_of(plan, "dt", "files", "rows", "action") == [
        ("2026-03-01", 2, 3, "compact"),
        ("2026-03-02", 1, 2, "compact"),
        ("2026-03-03", 0, 0, "no_raw"),
    ]
    assert all(r["raw_bytes"] > 0 for r in plan.where("files > 0").collect())
    # A plan writes nothing.
    assert partition_files(spark, table).count() == 0


def test_compaction_sorts_and_keeps_every_row(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    summary = compaction.compact(spark, [site], table, D1, D4, as_of=D4)
    assert rows_of(summary, "dt", "files", "rows", "skipped") == [
        ("2026-03-01", 2, 3, False),
        ("2026-03-02", 1, 2, False),
        ("2026-03-03", 0, 0, True),
    ]
    for r in summary.collect():
        if r["skipped"]:
            assert (r["raw_bytes"], r["compact_bytes"], r["ratio"]) == (0, 0, 0.0)
        else:
            assert r["compact_bytes"] > 0
            assert r["ratio"] == pytest.approx(r["raw_bytes"] / r["compact_bytes"])
    totals = compaction.run_totals(summary)
    assert rows_of(totals, "compacted_days", "skipped_days", "files", "rows") == [(2, 1, 3, 5)]

    files = {r["dt"]: r["path"] for r in partition_files(spark, table).collect()}
    assert set(files) == {D1, D2}
    first = pq.ParquetFile(files[D1].removeprefix("file:"))
    stored = first.read().to_pylist()
    assert [(r["cs_uri_stem"], r["time"]) for r in stored] == [
        ("/", "00:05:00"),
        ("/", "00:10:00"),
        ("/a.css", "13:00:00"),
    ]
    assert first.metadata.row_group(0).column(0).compression == "ZSTD"
    # A column only some raw files have is kept.
    second = pq.read_table(files[D2].removeprefix("file:"), partitioning=None)
    assert set(second.column("x_edge_location").to_pylist()) == {"FRA2"}
    assert set(NARROW_COLUMNS) < set(second.column_names)

    raw = log_source.read_raw(spark, log_source.raw_day_folders(spark, [site], D1, D2))
    compacted = log_source.read_narrow(spark, table)
    assert rows_of(compacted) == rows_of(raw, *compacted.columns)


def test_second_compaction_changes_nothing_unless_forced(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    compaction.compact(spark, [site], table, D1, D4, as_of=D4)
    before = rows_of(partition_files(spark, table))
    again = compaction.compact(spark, [site], table, D1, D4, as_of=D4)
    assert rows_of(again, "rows", "skipped") == [(0, True)] * 3
    assert rows_of(partition_files(spark, table)) == before
    plan = compaction.compaction_plan(spark, [site], table, D1, D4, as_of=D4)
    assert {r["action"] for r in plan.collect()} == {"exists", "no_raw"}

    land(spark, f"{site.log_path}/2026/03/01/14", [row(time="14:00:00")])
    forced = compaction.compact(spark, [site], table, D1, D1, as_of=D4, force=True)
    assert rows_of(forced, "files", "rows", "skipped") == [(3, 4, False)]
    kept = log_source.read_narrow(spark, table)
    assert rows_of(kept.groupBy("dt").count()) == [("2026-03-01", 4), ("2026-03-02", 2)]


def test_reading_falls_back_to_raw_days(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    whole = log_source.read_log(spark, [site], table, D1, D4)
    assert whole.count() == 6
    compaction.compact(spark, [site], table, D1, D2, as_of=D2)
    mixed = log_source.read_log(spark, [site], table, D1, D4)
    assert rows_of(mixed) == rows_of(whole)


def test_tiny_files_and_missing_days_are_passed_over(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    compaction.compact(spark, [site], table, D1, D4, as_of=D4)
    bad = tmp_path / "compact" / "domain=example.com" / "dt=2026-03-03"
    bad.mkdir()
    (bad / "part.parquet").write_bytes(b"PAR1")
    assert log_source.read_narrow(spark, table).count() == 5
    assert D3 not in {r["dt"] for r in partition_days(spark, table).collect()}
    assert log_source.read_narrow(spark, table, D2, D2).count() == 2
    assert log_source.read_narrow(spark, str(tmp_path / "nothing")).count() == 0


def test_large_day_becomes_several_sorted_files(spark, tmp_path):
    """A day far over the advisory size is split instead of written by one task."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    old = {k: spark.conf.get(k, None) for k in (size, least)}
    table = str(tmp_path / "compact")
    hot = (
        spark.range(0, 200_000, numPartitions=16)
        .select(
            F.lit("hot.com").alias("domain"),
            F.lit(D1).alias("dt"),
            F.md5(F.col("id").cast("string")).alias("cs_uri_stem"),
            F.lit("2026-03-01").alias("date"),
        )
    )
    try:
        spark.conf.set(size, "1m")
        spark.conf.set(least, "100k")
        compaction.sort_and_write(hot, table)
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    paths = [r["path"] for r in partition_files(spark, table).collect()]
    assert len(paths) > 2
    total = 0
    for path in paths:
        stems = pq.read_table(
            path.removeprefix("file:"), columns=["cs_uri_stem"], partitioning=None
        ).column(0).to_pylist()
        assert stems == sorted(stems)
        total += len(stems)
    assert total == 200_000


def sync(spark, root, table, wanted, as_of, forced=None):
    plan = refresh.refresh(spark, table, wanted, root, BOTS, as_of, forced)
    return rows_of(plan, "dt", "reason")


def test_refresh_takes_new_days_today_and_forced_ones(spark, tmp_path):
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D3)
    full = log(
        spark,
        [row(ip="1"), row(ip="2"), row("2026-03-02", ip="1", agent=GOOGLE), row("2026-03-03")],
    )
    assert sync(spark, root, full.where(F.col("dt") <= D2), wanted, D3) == [
        ("2026-03-01", "new"),
        ("2026-03-02", "new"),
        ("2026-03-03", "today"),
    ]
    # The next run: cached days stay, today is read again, even with new rows elsewhere.
    later = full.unionByName(log(spark, [row(ip="ignored")]))
    assert sync(spark, root, later, wanted, D3) == [("2026-03-03", "today")]
    narrow = log_source.read_narrow(spark, f"{root}/{refresh.NARROW}")
    assert rows_of(narrow) == rows_of(full, *narrow.columns)

    # Day 3 was read before it was over, so it is read once more.
    forced = sync(spark, root, later, wanted, D4, F.col("dt") == D1)
    assert forced == [("2026-03-01", "forced"), ("2026-03-03", "part_day")]
    assert sync(spark, root, later, wanted, D4) == []
    daily = reports.day_metric(refresh.read_day_metrics(spark, root), "traffic")
    assert rows_of(daily, "dt", "hits", "visitors") == [
        ("2026-03-01", 3, 3),
        ("2026-03-02", 1, 1),
        ("2026-03-03", 1, 1),
    ]
    visitors = refresh.read_visitors(spark, root)
    assert rows_of(rollups.range_visitors(visitors, D1, D2)) == [("example.com", 3, 1)]
    assert rows_of(refresh.read_visitors(spark, root, D2, D2), "c_ip", "is_bot") == [("1", True)]


def test_refetched_day_that_came_back_empty_loses_its_rows(spark, tmp_path):
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D2)
    full = log(spark, [row(), row("2026-03-02")])
    sync(spark, root, full, wanted, D3)
    sync(spark, root, full.where(F.col("dt") == D1), wanted, D2)
    narrow = log_source.read_narrow(spark, f"{root}/{refresh.NARROW}")
    assert rows_of(narrow.select("dt")) == [("2026-03-01",)]
    table = refresh.read_day_metrics(spark, root)
    assert rows_of(reports.day_metric(table, "traffic"), "dt", "hits") == [
        ("2026-03-01", 1),
        ("2026-03-02", 0),
    ]
    assert rows_of(reports.day_metric(table, "page"), "dt") == [("2026-03-01",)]


def test_lost_visitor_rows_are_rebuilt(spark, tmp_path):
    root = str(tmp_path / "tables")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D2)
    full = log(spark, [row(), row("2026-03-02", ip="2")])
    sync(spark, root, full, wanted, D3)
    drop_partitions(spark, [f"{root}/{refresh.VISITORS}/domain=example.com/dt={D1}"])
    assert sync(spark, root, full, wanted, D3) == []
    assert rows_of(refresh.read_visitors(spark, root), "dt", "c_ip") == [
        ("2026-03-01", "1.1.1.1"),
        ("2026-03-02", "2"),
    ]


def test_published_reports_read_back(spark, tmp_path):
    root = str(tmp_path / "reports")
    wanted = calendars.site_days(sites_table(spark, [Site("example.com")]), D1, D3)
    rows = [row(path=p) for p in ["/b", "/a", "/b", "/c.css"]]
    found = classify(log(spark, rows), BOTS)
    table = reports.day_metrics(found, wanted).cache()
    made = {
        **reports.period_tables(table, rollups.visitor_days(found), "month"),
        **reports.period_tables(table, rollups.visitor_days(found), "year"),
    }
    reports.publish(made, root)
    for name, frame in made.items():
        stored = spark.read.schema(frame.schema).parquet(f"{root}/{name}")
        assert rows_of(stored, *frame.columns) == rows_of(frame), name
    pages = list((tmp_path / "reports" / "month_pages").rglob("*.parquet"))
    assert len(pages) == 1
    order = pq.read_table(pages[0], partitioning=None).column("path").to_pylist()
    assert order == ["/b", "/a", "/c.css"]
    years = reports.available_years(spark.read.parquet(f"{root}/year_totals"), F.lit(2027))
    assert [r["year"] for r in years.collect()] == [2026, 2027]


def test_scratch_space_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, other = fresh_folder(spark, "x"), fresh_folder(spark, "x")
    assert one != other
    assert one.startswith(shared)


def test_only_counted_key_tables_are_broadcast(spark, monkeypatch):
    keys = spark.range(10)
    assert "ResolvedHint" in broadcast_if_small(keys)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 5)
    assert "ResolvedHint" not in broadcast_if_small(keys)._jdf.queryExecution().analyzed().toString()


def test_day_range_reads_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "tables")
    refresh.write_narrow(log(spark, [row(), row("2026-03-02")]), root)
    table = f"{root}/{refresh.NARROW}"
    plan = log_source.read_narrow(spark, table, D1, D1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert rows_of(partition_days(spark, table)) == [
        ("example.com", "2026-03-01"),
        ("example.com", "2026-03-02"),
    ]
    assert DAY_KEYS == ["domain", "dt"]
