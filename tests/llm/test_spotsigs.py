"""Spot signatures against a plain implementation."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from logtide.llm import spotsigs
from tests.llm import edges

ANCHORS = set(spotsigs.ANCHORS)


def _words(text: str) -> list[str]:
    is_word = lambda c: unicodedata.category(c)[0] in "L" or unicodedata.category(c)[0] == "N"
    return "".join(c if is_word(c) else " " for c in text.lower()).split()


def _spots(text: str) -> set[tuple]:
    words = _words(text)
    found = set()
    for i, word in enumerate(words[:-1]):
        if word in ANCHORS and words[i + 1] not in ANCHORS:
            chain = [w for w in words[i + 1 : i + 400] if w not in ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((word, *chain))
    return found or ({tuple(words)} if words else set())


def _likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def _ordered() -> list[tuple]:
    return sorted(edges.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("range_rows", [2, 5, 1000])
def test_edits_match_a_plain_implementation(spark, range_rows):
    rows = [r for r in _ordered()]
    found = spotsigs.fingerprint_edits(edges.documents(spark), range_rows=range_rows).collect()
    expected = []
    for i, row in enumerate(rows):
        text, after = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append(
            (
                row[0],
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                round(_likeness(_spots(text), _spots(edited)), 9),
                round(_likeness(_spots(text), _spots(after)), 9),
                len(_spots(text)),
            )
        )
    got = [
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), r.n_signatures)
        for r in found
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_equal_sets_have_equal_fingerprints(spark):
    docs = edges.documents(spark)
    rows = spotsigs.with_signatures(docs.select(F.coalesce("text", F.lit("")).alias("text")), "text", "own")
    prints = {r.text: r.print for r in rows.select("text", spotsigs.digest(F.col("own")).alias("print")).collect()}
    for a, x in prints.items():
        for b, y in prints.items():
            assert (x == y) == (_spots(a) == _spots(b))


def test_plan_is_native(spark):
    plan = spotsigs.fingerprint_edits(edges.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_row_and_none(spark):
    assert spotsigs.fingerprint_edits(edges.no_documents(spark)).collect() == []
    one = spark.createDataFrame([(5, edges.PROSE, "en", "a", 1)], edges.SCHEMA)
    found = spotsigs.fingerprint_edits(one).first()
    assert (found.near_next, found.n_chars) == (1.0, len(edges.PROSE))


def _copies(seed: int) -> list[tuple]:
    """Documents, exact copies, and copies with some words exchanged."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "is"] * 60
    docs = []
    for _ in range(40):
        words = draw.choices(vocabulary, k=draw.randint(5, 120))
        docs.append(words)
        for _ in range(draw.randint(0, 3)):
            near = list(words)
            for _ in range(draw.randint(0, 4)):
                near[draw.randrange(len(near))] = draw.choice(vocabulary)
            docs.append(near)
    return [(i, " ".join(words), "en", "a", 0) for i, words in enumerate(docs)]


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_similar_pairs_match_brute_force(spark, similarity):
    docs = _copies(3)
    rows, pairs = spotsigs.similar_pairs(spark.createDataFrame(docs, edges.SCHEMA), similarity)
    print_of = {r.doc_id: r.fingerprint for r in rows.collect()}
    sets = {print_of[d[0]]: _spots(d[1]) for d in docs}
    names = sorted(sets)
    expected = {
        (a, b)
        for i, a in enumerate(names)
        for b in names[i + 1 :]
        if sets[a] and _likeness(sets[a], sets[b]) >= similarity
    }
    assert expected
    assert {(r.a, r.b) for r in pairs.collect()} == expected


def test_similar_pairs_of_awkward_rows(spark):
    rows, pairs = spotsigs.similar_pairs(edges.documents(spark))
    assert rows.count() == len(edges.rows())
    assert pairs.where("a >= b").count() == 0
    rows, pairs = spotsigs.similar_pairs(edges.no_documents(spark))
    assert (rows.count(), pairs.count()) == (0, 0)
