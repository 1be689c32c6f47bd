"""Sharding against a search over all capacities."""

from __future__ import annotations

import random
import re
import zlib
from itertools import accumulate

import pytest

from logtide.llm import sharding
from tests.llm import edges


def _smallest_capacity(sizes: list[int], shards: int) -> int:
    def needed(capacity):
        n, held = 1, 0
        for size in sizes:
            if held + size > capacity:
                n, held = n + 1, 0
            held += size
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def _check(rows: list[tuple], found: list, shards: int) -> dict[int, int]:
    assert len(found) == len(rows)
    text = {}
    for key, value, *_ in rows:
        text.setdefault(zlib.crc32((value or "").encode()), (value or "", []))[1].append(key)
    place: dict[int, set] = {}
    held: dict[int, int] = {}
    slots: dict[int, list] = {}
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert r.size == len(text[r.text_crc32][0].encode()) + 16
        place.setdefault(r.text_crc32, set()).add(r.shard)
        held[r.shard] = held.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    low = lambda keys: min((k is not None, k or 0) for k in keys)
    order = sorted(text, key=lambda crc: low(text[crc][1]))
    assert [min(place[c]) for c in order] == sorted(min(place[c]) for c in order)
    sizes = [(len(text[c][0].encode()) + 16) * len(text[c][1]) for c in order]
    assert max(held.values()) <= _smallest_capacity(sizes, shards)
    return held


def _random_rows(seed: int, n: int, hot: float) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = "hot text " * 3 if draw.random() < hot else "x" * draw.choice([1, 5, 30, 200, 2000]) + str(i % (n // 2))
        rows.append((i * 7 - 50, text, "en", "a", 0))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot, shards, blocks, range_rows", [(1, 0.0, 10, 8, 20), (2, 0.4, 7, 5, 50), (3, 0.1, 40, 4096, 20_000)])
def test_largest_shard_is_as_small_as_can_be(spark, seed, hot, shards, blocks, range_rows):
    rows = _random_rows(seed, 300, hot)
    docs = spark.createDataFrame(rows, edges.SCHEMA)
    found = sharding.shard_documents(docs, shards, blocks=blocks, range_rows=range_rows).collect()
    held = _check(rows, found, shards)
    if not hot:
        assert max(held.values()) < 1.6 * sum(held.values()) / shards
    # Slots follow the keys.
    for number in held:
        own = sorted((r.slot, r.doc_id) for r in found if r.shard == number)
        assert [k for _, k in own] == sorted(k for _, k in own)


def test_reruns_agree(spark):
    docs = spark.createDataFrame(_random_rows(4, 200, 0.2), edges.SCHEMA)
    first = sharding.shard_documents(docs, 9).collect()
    again = sharding.shard_documents(docs.repartition(7), 9).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_awkward_rows(spark, shards):
    found = sharding.shard_documents(edges.documents(spark), shards)
    assert [f.simpleString() for f in found.schema] == [
        "doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int",
    ]
    _check(edges.rows(), found.collect(), shards)


def test_no_rows(spark):
    assert sharding.shard_documents(edges.no_documents(spark), 40).collect() == []


def test_plan_is_native(spark):
    plan = sharding.shard_documents(edges.documents(spark), 3)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


class _Known(sharding.RunningTotals):
    """Totals that a list knows instead of a table; a look shows a few in each region."""

    def look(self, regions):
        points = dict(zip(self.known, [*self.hidden, False], strict=True))
        for low, high in regions:
            inside = [t for t in self.table if low <= t <= high]
            gaps = sum(low <= p < high for p in points)
            shown = sorted({low, high, *inside[:: max(1, len(inside) // (8 + 2 * gaps))]})
            for at, after in zip(shown, shown[1:], strict=False):
                points[at] = sum(at < t < after for t in inside) > 0
        self.known = sorted(points)
        self.hidden = [points[p] for p in self.known[:-1]]


def _held(sizes: list[int], shards: int, blocks: int) -> list[int]:
    ends = list(accumulate(sizes))
    totals = _Known(ends, ends[-1], blocks)
    capacity = sharding.smallest_capacity(totals, shards, max(sizes))
    large = sorted(zip(sizes, ends, strict=True), reverse=True)[:shards]
    cuts = sharding.even_cuts(totals, shards, capacity, large)
    assert set(cuts) <= set(ends) and cuts[-1] == ends[-1]
    return [b - a for a, b in zip([0, *cuts], cuts, strict=False)]


@pytest.mark.parametrize("share", [0.1, 1 / 3])
@pytest.mark.parametrize("place", [0, 0.1, 0.5, 0.9, 1])
def test_a_hot_group_leaves_no_shard_empty(share, place):
    sizes = [1000] * 4000
    hot = int(4_000_000 * share / (1 - share))
    sizes.insert(int(4000 * place), hot)
    held = sorted(_held(sizes, 40, 8))
    assert held[-1] == hot
    # The other shards are near a 39th of the rest.
    assert 0.5 * 4_000_000 / 39 < held[0] and held[-2] < 1.5 * 4_000_000 / 39


def test_cuts_are_next_to_the_ideal_places():
    assert max(_held([1000] * 4000, 40, 4)) == 100_000 == min(_held([1000] * 4000, 40, 4))
