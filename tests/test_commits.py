"""Compaction runs that end early, and what readers see meanwhile."""

from __future__ import annotations

from datetime import date

import pytest

from logtide.plans import compaction, tables
from logtide.sources import commits
from logtide.sources.commits import committed_files, partition_days, partition_files
from logtide.sources.logs import read_log, read_narrow
from logtide.sources.lookups import Site
from tests.logs import log, row, rows_of

D1, D2, D4 = (date(2026, 3, d) for d in (1, 2, 4))


class Stopped(RuntimeError):
    pass


def stop(*_, **__):
    raise Stopped


@pytest.fixture
def site(spark, tmp_path):
    land(spark, tmp_path, "2026/03/01/00", [row(ip="1"), row(ip="2")])
    land(spark, tmp_path, "2026/03/02/00", [row("2026-03-02", ip="3")])
    return Site("example.com", str(tmp_path / "raw"))


def land(spark, tmp_path, folder, rows):
    frame = log(spark, rows).drop("domain", "dt")
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "raw" / folder))


def compact(spark, site, table, **options):
    return compaction.compact(spark, [site], table, D1, D4, as_of=D4, **options)


def addresses(spark, table):
    return rows_of(read_narrow(spark, table), "dt", "c_ip")


ALL = [("2026-03-01", "1"), ("2026-03-01", "2"), ("2026-03-02", "3")]


def test_run_that_ends_before_its_commit_is_done_again(spark, site, tmp_path, monkeypatch):
    table = str(tmp_path / "compact")
    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", stop)
        with pytest.raises(Stopped):
            compact(spark, site, table)
    # The files are there, but no reader takes them, and the days are not held.
    assert len(list((tmp_path / "compact").rglob("domain=*/dt=*/*.parquet"))) == 2
    assert addresses(spark, table) == []
    assert partition_days(spark, table).count() == 0
    assert rows_of(read_log(spark, [site], table, D1, D4), "dt", "c_ip") == ALL
    assert rows_of(compact(spark, site, table), "dt", "rows", "skipped")[:2] == [
        ("2026-03-01", 2, False),
        ("2026-03-02", 1, False),
    ]
    assert addresses(spark, table) == ALL
    # What the first run left behind is gone.
    assert len(list((tmp_path / "compact").rglob("domain=*/dt=*/*.parquet"))) == 2


def test_readers_see_old_days_until_the_new_ones_are_whole(spark, site, tmp_path, monkeypatch):
    table = str(tmp_path / "compact")
    compact(spark, site, table)
    land(spark, tmp_path, "2026/03/01/09", [row(ip="9")])
    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", stop)
        with pytest.raises(Stopped):
            compact(spark, site, table, force=True)
    assert addresses(spark, table) == ALL
    # In force, but the run ends before the old files are deleted.
    with monkeypatch.context() as patch:
        patch.setattr(commits, "drop_partitions", stop)
        with pytest.raises(Stopped):
            compact(spark, site, table, force=True)
    new = sorted([*ALL, ("2026-03-01", "9")])
    assert addresses(spark, table) == new
    assert len(list((tmp_path / "compact").rglob("domain=*/dt=*/*.parquet"))) == 6
    compact(spark, site, table, force=True)
    assert addresses(spark, table) == new
    assert partition_files(spark, table).count() == len(list((tmp_path / "compact").rglob("dt=*/*.parquet"))) == 2


def test_version_that_was_not_written_whole_does_not_count(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    compact(spark, site, table)
    (tmp_path / "compact/_commits/version=1/_SUCCESS").unlink()
    assert addresses(spark, table) == []
    compact(spark, site, table)
    assert addresses(spark, table) == ALL


def test_table_of_another_writer_is_taken_over(spark, site, tmp_path):
    """All its files count, also when the first commit is added and when that run ends early."""
    table = str(tmp_path / "compact")
    tables.write_partitioned(log(spark, [row(ip="7")]), table, ["domain", "dt"])
    assert committed_files(spark, table) is None
    assert addresses(spark, table) == [("2026-03-01", "7")]
    summary = compact(spark, site, table)
    assert rows_of(summary, "dt", "skipped") == [("2026-03-01", True), ("2026-03-02", False), ("2026-03-03", True)]
    assert addresses(spark, table) == [("2026-03-01", "7"), ("2026-03-02", "3")]


def test_many_versions_are_merged(spark, site, tmp_path):
    table = str(tmp_path / "compact")
    for day in (D1, D2):
        compaction.compact(spark, [site], table, day, day, as_of=D4)
    before = rows_of(committed_files(spark, table))
    commits.merge(spark, table, most=1)
    assert [p.name for p in (tmp_path / "compact/_commits").glob("version=*")] == ["version=3"]
    assert rows_of(committed_files(spark, table)) == before
    assert addresses(spark, table) == ALL
