"""License scan against a plain search, and its rules one by one."""

from __future__ import annotations

import re

from logtide.llm import license_scan
from tests.llm import edges

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _base(text: str) -> tuple:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_phrases_match_a_plain_search(spark):
    found = license_scan.scan(edges.documents(spark))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *_base(r[1] or "")) for r in edges.rows()), key=repr)
    assert license_scan.scan(edges.no_documents(spark)).collect() == []


def test_hundreds_of_rules_each_behind_a_keyword_it_contains():
    rules = license_scan.rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == list(range(len(rules)))
    for rule in rules:
        assert rule.keyword in rule.pattern.pattern, rule


def test_prefilter_loses_nothing():
    """The rules opened by keywords find what all rules would find."""
    texts = [rule.keyword + " license version 2 0 and " + rule.label.replace("-", " ") for rule in license_scan.rules()]
    for text in texts + [t for t in edges.TEXTS if t]:
        line = f" {' '.join(text.encode().translate(license_scan._WORD_BYTES).decode().split())} "
        every = {(m.start(), m.end()) for r in license_scan.rules() for m in r.pattern.finditer(line)}
        kept = {(a, b) for a, b, _ in license_scan.detections(line)}
        assert kept <= every
        assert all(any(a <= s and e <= b for a, b in kept) for s, e in every), text


def test_containment_and_priority():
    found = license_scan.scan_text("Released under the MIT License. See the MIT license, or GPL v2.")
    assert [(d["label"], d["start"], d["end"]) for d in found["detections"]] == [
        ("mit", 0, 5),
        ("mit", 7, 9),
        ("gpl-2.0", 10, 12),
    ]
    assert found["score"] == 0.95
    # The notice holds the name and the tag, which are suppressed.
    found = license_scan.scan_text("Licensed under CC BY-NC 4.0.")
    assert [d["label"] for d in found["detections"]] == ["cc-by-nc-4.0"]
    assert (found["base_labels"], found["labels"]) == ("cc-by", "cc-by,cc-by-nc-4.0")


def test_many_detections_in_a_long_text():
    found = license_scan.scan_text("cc by " * 50_000)
    assert (found["n_base"], found["first_word"], found["last_word"]) == (50_000, 0, 99_998)
    assert found["n_detections"] == 50_000
