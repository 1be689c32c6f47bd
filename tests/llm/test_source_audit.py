"""The source audit against plain integers, term by term."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logtide.llm import source_audit
from tests.llm import edges

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _expected(docs: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    held, documents = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in docs:
        own = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        held[lang, source].update(own)
        documents[lang].update(set(own))
    rows = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        p = {}
        everything = Counter()
        for name in sources:
            everything.update({t: held[lang, name][t] for t in kept})
            n = sum(held[lang, name][t] for t in kept)
            p[name] = {t: 1 + 10**9 * (held[lang, name][t] + 1) // (n + len(kept)) for t in kept}
        n = sum(everything[t] for t in kept)
        q = {t: 1 + 10**9 * (everything[t] + 1) // (n + len(kept)) for t in kept}
        for name in sources:
            price = lambda a, b: (a - b) ** 2 // b
            own = [(sum(price(p[name][t], p[o][t]) for t in kept), o) for o in sources if o != name]
            more = [(price(p[name][t], q[t]), t) for t in kept if held[lang, name][t] and p[name][t] > q[t]]
            for part, found, limit in (("pair", own, None), ("term", more, top)):
                found.sort(key=lambda e: (-e[0], e[1].encode()))
                rows += [(lang, name, part, item, v, i + 1) for i, (v, item) in enumerate(found[:limit])]
    return sorted(rows)


def _found(frame) -> list[tuple]:
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, frame.collect()))


def _random_docs(seed: int, n: int, sources: int) -> list[tuple]:
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["é", "Ü", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [
        (
            i,
            " ".join(draw.choices(words, weights, k=draw.randint(0, 60))),
            draw.choices(["en", "de", None, ""], [20, 5, 1, 1])[0],
            # One source has a third of all rows.
            draw.choices(["hot", None, *(f"s{k}" for k in range(sources))], [sources / 2, *[1] * (sources + 1)])[0],
            0,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("cells, terms, columns, names", [(1, 1, 4, 1), (60, 7, 9, 3), (1 << 21, 8192, 1024, 64)])
def test_matches_plain_integers(spark, monkeypatch, cells, terms, columns, names):
    """One block or many, products of one term or of all, sources one by one or together."""
    monkeypatch.setattr(source_audit, "PRODUCT_TERMS", terms)
    monkeypatch.setattr(source_audit, "PRODUCT_COLUMNS", columns)
    monkeypatch.setattr(source_audit, "PRODUCT_SOURCES", names)
    docs = _random_docs(cells, 300, 5)
    found = source_audit.audit_sources(spark.createDataFrame(docs, edges.SCHEMA), block_cells=cells, top_terms=9)
    assert _found(found) == _expected(docs, top=9)


@pytest.mark.parametrize("seed", range(4))
def test_products_price_every_pair(monkeypatch, seed):
    draw = np.random.default_rng(seed)
    monkeypatch.setattr(source_audit, "PRODUCT_COLUMNS", 12)
    monkeypatch.setattr(source_audit, "PRODUCT_SOURCES", seed + 1)
    counts = draw.geometric(0.4, (80, 5)) - 1
    counts[::9] *= draw.integers(1, 10**9, (9, 5))
    totals = counts.sum(axis=0).tolist()
    p = [[1 + 10**9 * (int(c) + 1) // (totals[at] + 80) for c in counts[:, at]] for at in range(5)]
    expected = [[sum((a - b) ** 2 // b for a, b in zip(x, y, strict=True)) for y in p] for x in p]
    assert source_audit.pair_values(counts, totals, 80).tolist() == expected


def test_counts_beyond_64_bits():
    counts = np.array([0, 5, 10**10, 9 * 10**17])
    whole = 10**18
    assert source_audit.probabilities(counts, whole, 7).tolist() == [
        1 + 10**9 * (int(c) + 1) // (whole + 7) for c in counts
    ]


def test_awkward_rows(spark):
    assert _found(source_audit.audit_sources(edges.documents(spark))) == _expected(edges.rows())


def test_languages_without_terms_and_nothing(spark):
    docs = [(1, None, "en", "a", 0), (2, "one", "en", "b", 0), (3, "", "en", None, 0), (4, "x", "de", "a", 0)]
    found = _found(source_audit.audit_sources(spark.createDataFrame(docs, edges.SCHEMA)))
    assert found == _expected(docs)
    assert {r[4] for r in found} == {0} and len(found) == 6
    assert source_audit.audit_sources(edges.no_documents(spark)).collect() == []
