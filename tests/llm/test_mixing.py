"""Mixing against exact arithmetic."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest

from logtide.llm import mixing
from tests.llm import edges


def _size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _targets(sizes: dict, epochs: int = 3) -> dict:
    """Water-filling, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        level = Fraction(rest, sum(weight[s] for s in names if s not in capped) or 1)
        more = {s for s in names if s not in capped and level * weight[s] > epochs * sizes[s]}
        if not more:
            return {s: epochs * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def _check(docs, found):
    sizes: dict = {}
    for _, text, _, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + _size(text)
    targets = _targets(sizes)
    by_source: dict = {}
    largest: dict = {}
    for (key, size, source_size, target, copies, taken), source in found:
        assert source_size == sizes[source]
        assert target == pytest.approx(float(targets[source]), rel=1e-12)
        assert taken == copies * size <= 3 * size
        by_source[source] = by_source.get(source, 0) + taken
        largest[source] = max(largest.get(source, 0), size)
    for source, taken in by_source.items():
        assert abs(taken - targets[source]) <= largest[source] / 2 + 1e-6, source


def _random_docs(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    names = [None, "a", "B", "é", "zz", "z"]
    return [
        (i, "w " * draw.randint(0, 30), "en", draw.choices(names, [1, 40, 3, 3, 3, 3])[0], 0) for i in range(400)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    docs = _random_docs(seed)
    frame = spark.createDataFrame(docs, edges.SCHEMA)
    source = {r[0]: r[3] for r in docs}
    first = mixing.mix_counts(frame, 7).collect()
    assert len(first) == len(docs)
    _check(docs, [(tuple(r), source[r.doc_id]) for r in first])
    again = mixing.mix_counts(frame.repartition(5), 7).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert sorted(map(tuple, first)) != sorted(map(tuple, mixing.mix_counts(frame, 8).collect()))


def test_mixed_rows_are_the_counted_ones(spark):
    docs = spark.createDataFrame(_random_docs(3), edges.SCHEMA)
    counts = {r.doc_id: r.copies for r in mixing.mix_counts(docs, 7).collect()}
    mixed = mixing.mixed(docs, 7)
    assert mixed.columns == docs.columns
    found: dict = {}
    for row in mixed.collect():
        found[row.doc_id] = found.get(row.doc_id, 0) + 1
    assert found == {k: n for k, n in counts.items() if n}


def test_awkward_rows(spark):
    docs = edges.documents(spark)
    found = mixing.mix_counts(docs, 7).collect()
    assert len(found) == len(edges.rows())
    assert all(0 <= r.copies <= 3 for r in found)
    mixed = mixing.mixed(docs, 7)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in found)


def test_no_rows_and_no_words(spark):
    none = edges.no_documents(spark)
    assert mixing.mix_counts(none, 7).collect() == []
    assert mixing.mixed(none, 7).collect() == []
    empty = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], edges.SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.mix_counts(empty, 7).collect()] == [(0, 0.0, 0)] * 2
