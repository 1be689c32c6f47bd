"""License and copyright statements in whole texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import ship_package, whole_text
from logtide.llm.license_rules import SECTIONS

#: Phrases whose every place counts, whatever the rules find.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Letters A-Z to lower case; what is in no word becomes a space.
_WORD_BYTES = bytes(
    byte + 32
    if 0x41 <= byte <= 0x5A
    else byte
    if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80
    else 0x20
    for byte in range(256)
)


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern[str]
    strength: float


def _anchored(pattern: str) -> re.Pattern[str]:
    return re.compile(f"(?<= )(?:{pattern})(?= )")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the first of highest priority."""
    found = []
    for section, strength in SECTIONS:
        for line in section.strip().splitlines():
            label, keyword, pattern = line.split(" : ", 2)
            found.append(Rule(len(found), label, keyword, _anchored(pattern), strength))
    return tuple(found)


@lru_cache(maxsize=1)
def _prefilter() -> ahocorasick.Automaton:
    """Finds the keywords of a text; each names the rules it opens."""
    opened: dict[str, list[int]] = {}
    for rule in rules():
        opened.setdefault(rule.keyword, []).append(rule.priority)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in opened.items():
        # Keywords begin at a word, as patterns do, so a word's middle opens none.
        automaton.add_word(f" {keyword}", tuple(numbers))
    automaton.make_automaton()
    return automaton


@lru_cache(maxsize=1)
def _base_patterns() -> tuple[tuple[str, re.Pattern[str]], ...]:
    return tuple((label, _anchored(phrase)) for phrase, label in BASE_PHRASES.items())


def _word_numbers(line: str, places: list[int]) -> dict[int, int]:
    """The number of the word at each place, in one pass over the line."""
    numbers, at, number = {}, 0, -1
    for place in sorted(set(places)):
        number += line.count(" ", at, place)
        numbers[place], at = number, place
    return numbers


def detections(line: str) -> list[tuple[int, int, Rule]]:
    """``(start, end, rule)`` of what is left of all matches, as places in the line.

    ``line`` holds the words with a space before, between and after them. A
    match inside the interval of one of higher priority says nothing new and is
    suppressed; intervals that only overlap both stay.
    """
    opened: set[int] = set()
    for _, numbers in _prefilter().iter(line):
        opened.update(numbers)
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []
    for number in sorted(opened):
        rule = rules()[number]
        fresh = []
        for match in rule.pattern.finditer(line):
            start, end = match.span()
            # The furthest end of the kept intervals that begin no later.
            at = bisect_right(starts, start) - 1
            if at < 0 or reach[at] < end:
                fresh.append((start, end, rule))
        if fresh:
            kept = sorted(kept + fresh, key=lambda d: d[:2])
            starts = [d[0] for d in kept]
            reach = list(accumulate((d[1] for d in kept), max))
    return kept


def scan_text(text: str) -> dict:
    """The row of one text; see ``scan``."""
    words = text.encode().translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode()} "
    base = [
        (match.start(), label)
        for label, pattern in _base_patterns()
        for match in pattern.finditer(line)
    ]
    found = detections(line)
    number = _word_numbers(line, [p for p, _ in base] + [p for d in found for p in d[:2]])
    starts = [number[place] for place, _ in base]
    base_labels = {label for _, label in base}
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | {rule.label for _, _, rule in found})),
        "score": max((rule.strength for _, _, rule in found), default=0.0),
        "n_detections": len(found),
        "detections": [
            # A match ends in front of a space, in its last word.
            {"label": rule.label, "start": number[start], "end": number[end] + 1}
            for start, end, rule in found
        ],
    }


_KIND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("n_detections", pa.int64()),
        (
            "detections",
            pa.list_(
                pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            ),
        ),
    ]
)
_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, n_detections long, "
    "detections array<struct<label: string, start: long, end: long>>"
)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its license statements.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell of the
    base phrases alone, at all their places. ``labels`` adds the rules' labels;
    ``detections`` has the words each stands on (from 0, end not included).
    ``score`` is the strength of the strongest detection: 1 for a sentence of a
    license, 0.95 for a notice, 0.8 for a name, 0.6 for a tag, 0 for none.

    A null text counts as empty: no words, nothing found, label lists empty,
    first and last word null. A null key stays null; equal and repeated rows
    each give a row; texts are scanned whole, however long. Other columns of
    ``docs`` are not read, and no row leaves its partition.
    """
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scan_text(text.as_py()) for text in batch], _KIND)

    found = F.arrow_udf(rows, _SCHEMA)(whole_text(text)).alias("found")
    return docs.select(F.col(key), found).select(key, "found.*")
