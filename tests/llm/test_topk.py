"""Top-k against all inner products."""

from __future__ import annotations

import math
import random

import pytest

from logtide.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string"


def _scaled(vector) -> tuple | None:
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return tuple(math.floor(64 * x) for x in vector)


def _expected(rows, is_query, k):
    own = {(r[0], v) for r in rows if r[0] is not None and (v := _scaled(r[1])) is not None}
    found = []
    for q, x in own:
        if not is_query(q):
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), c) for c, y in own if c != q]
        found += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def _rows(draw: random.Random, n: int, dim: int) -> list[tuple]:
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        vector = [round((c + draw.gauss(0, 0.3)) * 4) / 4 for c in draw.choice(centres)]
        rows.append((i, vector, 0, "x", "y"))
    return rows


def _search(spark, rows, k=5, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = topk.top_k(frame, frame.where("vec_id % 3 = 0"), k, 64, **options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed, dim", [(1, 2), (2, 8)])
def test_matches_brute_force(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(topk, "TILE_ROWS", 5)
    monkeypatch.setattr(topk, "PIVOTS", 4)
    rows = _rows(random.Random(seed), 150, dim)
    assert _search(spark, rows, block_rows=10) == _expected(rows, lambda q: q % 3 == 0, 5)


def test_ties_and_a_vector_most_rows_share(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 8)
    rows = [(i, [1.0, 0.5] if i % 3 else [0.25 * (i % 5), 1.0], 0, "", "") for i in range(90)]
    assert _search(spark, rows, block_rows=7) == _expected(rows, lambda q: q % 3 == 0, 5)


def test_awkward_rows(spark):
    rows = [
        (0, [0.1, -0.1], 0, None, None),
        (1, None, 0, "a", "b"),
        (2, [float("nan"), 1.0], 0, "a", "b"),
        (3, [float("inf"), 1.0], 0, "a", "b"),
        (4, [None, 1.0], None, "a", "b"),
        (None, [1.0, 1.0], 0, "a", "b"),
        (5, [1.0, 1.0], 0, "a", "b"),
        (5, [1.0, 1.0], 0, "a", "b"),
        (6, [1e9, -1.0], 0, "a", "b"),
        (7, [0.0, 0.0], 0, "a", "b"),
        (9, [0.5, 0.5], 0, "a", "b"),
    ]
    assert _search(spark, rows) == _expected(rows, lambda q: q % 3 == 0, 5)
    # Shorter vectors are filled up with zeros.
    rows = [(0, [1.0], 0, "", ""), (1, [1.0, 2.0], 0, "", ""), (3, [0.5, 0.5], 0, "", ""), (4, [], 0, "", "")]
    assert _search(spark, rows) == _expected(rows, lambda q: q % 3 == 0, 5)


def test_nothing_to_search(spark):
    assert _search(spark, []) == []
    assert _search(spark, [(0, [1.0], 0, "", "")]) == []
    assert _search(spark, [(1, [1.0], 0, "", ""), (2, [1.0], 0, "", "")]) == []


def test_bounds_leave_most_pairs_of_clustered_vectors_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 10)
    monkeypatch.setattr(topk, "STEP_ROWS", 10)
    draw = random.Random(3)
    # Of one length, as the vectors of most models are.
    centres = [_unit([draw.gauss(0, 1) for _ in range(16)]) for _ in range(16)]
    rows = [
        (i, [4 * x for x in _unit([c + draw.gauss(0, 0.03) for c in centres[i % 16]])], 0, "", "")
        for i in range(640)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    answers, work = topk.search(frame, frame.where("vec_id % 3 = 0"), 5, 64)
    assert sorted(map(tuple, answers.collect())) == _expected(rows, lambda q: q % 3 == 0, 5)
    pairs = {r["round"]: r["pairs"] for r in work.collect()}
    assert set(pairs) <= {0, 1, 2}
    assert sum(pairs.values()) < 0.25 * len(rows) * len(range(0, len(rows), 3))


def _unit(vector):
    length = math.sqrt(sum(x * x for x in vector))
    return [x / length for x in vector]


def test_a_query_of_another_table_may_be_longer_or_larger(spark):
    rows = [(i, [float(i % 7), float(i % 3)], 0, "", "") for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(100, [1e9, 1.0, 5.0], 0, "", ""), (101, [0.25], 0, "", "")], SCHEMA)
    found = sorted(map(tuple, topk.top_k(frame, asked, 4, 64).collect()))
    expected = []
    for q, vector in ((100, [64 * 10**9, 64, 320]), (101, [16, 0])):
        scores = [(-sum(a * int(64 * b) for a, b in zip(vector, r[1])), r[0]) for r in rows]
        expected += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:4])]
    assert found == expected
