"""Quality rules: counts against plain loops, divergence against its definition, verdicts on awkward rows."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pytest

from logtide.llm import oracle, quality_rules
from tests.compare import mismatch
from tests.llm import edges


def _plain_counts(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated_lines += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, repeated_lines, len(inside), failed


def _plain_divergence(p: list[float], q: list[float]) -> float:
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    middle = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    entropy = lambda d: -sum(x * math.log2(x) for x in d if x > 0)
    return entropy(middle) - (entropy(p) + entropy(q)) / 2


def _texts() -> list[str]:
    draw = random.Random(3)
    short = [w for w in ["a", "b", "é", "日本", "#x", "a\n", "\n", "\x0b", "\x1c", " ", "$$"]]
    made = [" ".join(draw.choice(short) for _ in range(draw.randint(0, 90))) for _ in range(200)]
    return made + edges.random_texts(draw, 100) + [t or "" for t in edges.TEXTS if t is None or len(t) < 5000]


def test_counts_match_plain_loops():
    for text in _texts():
        assert quality_rules.base_counts(text.encode()) == _plain_counts(text), text


@pytest.mark.parametrize("width", [2, 3, 5])
def test_windows_of_many_different_words(width, monkeypatch):
    draw = random.Random(width)
    words = [b"%d" % draw.randint(0, 300) for _ in range(3_000)]
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(width)}
    assert quality_rules.repeated_words(words, width) == len(inside)
    # Sixteen words of 300 kinds don't fit 64 bits as one number.
    assert quality_rules.repeated_words([b"%d" % (i % 300) for i in range(600)], 16) == 600 - 0


def test_classes_and_terms():
    text = "aZ9 \n.#\x01é日🙂"
    assert quality_rules.class_counts(text.encode()).tolist() == [1, 1, 1, 1, 1, 1, 1, 1, 1, 2]
    for text in _texts():
        assert quality_rules.class_counts(text.encode()).sum() == len(text)
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        found = [t.decode() for t in quality_rules.terms(text.encode())]
        assert found == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def test_divergence_by_its_definition():
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 5, (20, 7))
    counts[:, 0] += 1
    reference = draw.integers(0, 9, 7).astype(float)
    found = quality_rules.divergence(counts, reference)
    assert found == pytest.approx([_plain_divergence(list(row), list(reference)) for row in counts], abs=1e-12)
    assert quality_rules.divergence(np.array([[0, 0], [3, 0]]), np.array([0.0, 5.0])).tolist() == [0.0, 1.0]


def _prose(draw: random.Random, n: int) -> str:
    common = "the of and to in a is that".split()
    return " ".join(draw.choice(common) if draw.random() < 0.5 else f"w{draw.choice('abcdefgh')}x" * 2 for _ in range(n))


def _corpus(junk: int, good: int = 60) -> list[tuple]:
    draw = random.Random(5)
    rows = [(i, _prose(draw, 300), "en", None, 0) for i in range(good)]
    rows += [(1000 + i, " ".join(f"{draw.choice('ABCDEFGH')}Q{i}-{k}!!" for k in range(300)), "en", None, 0) for i in range(junk)]
    return rows


@pytest.mark.parametrize("junk", [1, 30, 50])
def test_junk_is_found_even_where_it_is_much_of_a_language(spark, junk):
    """Thirty of ninety documents are a third, and fifty of a hundred and ten nearly half."""
    found = quality_rules.apply_rules(spark.createDataFrame(_corpus(junk), edges.SCHEMA)).collect()
    assert [r.doc_id for r in found if not r.kept and r.doc_id < 1000] == []
    assert [r.doc_id for r in found if r.kept and r.doc_id >= 1000] == []
    assert len(found) == 60 + junk


def test_short_texts_and_few_documents_are_not_judged(spark):
    rows = _corpus(0) + [(2000, "XQ!! " * 40, "en", None, 0), (2001, "XQ!! ", "en", None, 0)]
    found = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, edges.SCHEMA)).collect()}
    assert found[2001].class_distance == found[2001].word_distance == 0
    assert found[2000].word_distance == 0 < found[2000].class_distance
    few = quality_rules.apply_rules(spark.createDataFrame(_corpus(3, good=10), edges.SCHEMA)).collect()
    assert all(r.language is None and r.kept for r in few)


def test_awkward_rows(spark):
    found = quality_rules.apply_rules(edges.documents(spark)).collect()
    expected = [(r[0], *_plain_counts(r[1] or "")) for r in edges.rows() if len(r[1] or "") < 100_000]
    got = [tuple(r[:7]) for r in found if r.n_words < 20_000]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert len(found) == len(edges.rows())
    assert all(not r.kept for r in found if r.base_failed)
    assert quality_rules.apply_rules(edges.no_documents(spark)).collect() == []


def test_awkward_rows_match_sql(spark):
    # The comparison has no nulls among its integers.
    rows = [(-1 if r[0] is None else r[0], *r[1:]) for r in edges.rows() if "\x00" not in (r[1] or "")]
    docs = spark.createDataFrame(rows + _corpus(10, good=30), edges.SCHEMA)
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    assert mismatch(quality_rules.apply_rules(docs), oracle.QUALITY_RULES, connection) is None
