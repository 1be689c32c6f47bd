"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from logtide import oracle
from logtide import queries as catalogue
from tests.compare import connect, mismatch

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()
ORACLES = oracle.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_point_registers_them():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    # Three months of two sites: 31 + 31 + 29 days.
    assert entry_point.entry(spark).count() == 182


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, tables, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), ORACLES[name], tables) is None


# Fixed figures of the derived log at this scale, by site and month.
FIGURES = {
    ("a.example.com", "2023-12"): (123, 16, 63, 9),
    ("a.example.com", "2024-01"): (137, 16, 74, 9),
    ("a.example.com", "2024-02"): (129, 15, 67, 8),
    ("b.example.org", "2023-12"): (71, 14, 35, 7),
    ("b.example.org", "2024-01"): (74, 16, 38, 8),
    ("b.example.org", "2024-02"): (57, 16, 29, 8),
}


def test_known_month_figures(spark):
    rows = QUERIES["month_totals"](spark, SF_DIR).collect()
    names = ("hits", "visitors", "bot_hits", "bot_visitors")
    assert {(r["domain"], r["month"]): tuple(r[n] for n in names) for r in rows} == FIGURES
    bots: dict = {}
    for r in QUERIES["month_bots"](spark, SF_DIR).collect():
        key = (r["domain"][0], r["bot_name"])
        bots[key] = bots.get(key, 0) + r["hits"]
    assert len(bots) == 16
    assert (bots["a", "Google"], bots["a", "Google Images"], bots["a", "Bing"]) == (44, 52, 27)
    referers = QUERIES["month_referers"](spark, SF_DIR).collect()
    assert sum(r["hits"] for r in referers if r["domain"][0] == "a") == 104
    assert len({r["referer"] for r in referers if r["domain"][0] == "b"}) == 34
    missing = QUERIES["sitemap_gaps"](spark, SF_DIR).collect()
    assert sum(1 for r in missing if r["domain"][0] == "a" and r["month"] == "2023-12") == 44


def test_fixture_can_fail(spark):
    """Months, years and lists differ, and every count of left-out rows is above 0."""
    years = {(r["domain"], r["year"]): r["hits"] for r in QUERIES["year_totals"](spark, SF_DIR).collect()}
    assert years["a.example.com", 2024] == 137 + 129
    top = QUERIES["top_bots"](spark, SF_DIR).count()
    assert 0 < top < QUERIES["month_bots"](spark, SF_DIR).count()
    assert all(v for r in QUERIES["data_quality"](spark, SF_DIR).collect() for v in r)
