"""SimHash against plain bit counting, and components against a search."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from logtide.llm import simhash
from logtide.llm.components import connected_components
from tests.llm import edges


def _plain(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _smallest(values: list[int], keys: list, links) -> list:
    """The smallest key each value reaches."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        parent[root(i)] = root(j)
    least: dict = {}
    for i, key in enumerate(keys):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(values))]


def _near(values: list[int]) -> list[tuple[int, int]]:
    bits = np.array(values, dtype=np.uint64)
    apart = np.bitwise_count(bits[:, None] ^ bits[None, :])
    return list(zip(*np.nonzero(apart <= 2), strict=True))


def test_fingerprints_of_awkward_texts():
    for text in edges.TEXTS:
        assert simhash.fingerprint(text or "") % 2**64 == _plain(text or "")


def test_awkward_rows(spark):
    rows = edges.rows()
    values = [_plain(r[1] or "") for r in rows]
    least = _smallest(values, [r[0] for r in rows], _near(values))
    expected = [(r[0], f"{v:016x}", c) for r, v, c in zip(rows, values, least, strict=True)]
    found = simhash.near_duplicates(edges.documents(spark))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(edges.no_documents(spark)).collect() == []


def test_close_links_lose_no_connection(spark):
    """Random fingerprints, chains of near ones and a crowd, over tiles of a few rows."""
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63, 1, 3}
    for _ in range(15):
        value = draw.getrandbits(64)
        for _ in range(12):
            value ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
            values.add(value)
    crowd = draw.getrandbits(64)
    values |= {crowd ^ (1 << i) for i in range(64)}
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "bits long")
    links = simhash.close_links(frame, tile_rows=4).collect()
    place = {v: i for i, v in enumerate(signed)}
    found = _smallest(values, list(range(len(values))), [(place[r.a], place[r.b]) for r in links])
    assert found == _smallest(values, list(range(len(values))), _near(values))
    roots = {r.node: r.root for r in connected_components(simhash.close_links(frame)).collect()}
    same = {}
    for i, v in enumerate(signed):
        same.setdefault(roots.get(v, v), set()).add(found[i])
    assert all(len(group) == 1 for group in same.values())
    assert len(same) == len(set(found))


def test_a_crowd_gives_as_many_links_as_members():
    crowd = np.array([1 << i for i in range(60)], dtype=np.int64)
    a, b = simhash.tile_links(crowd, None, 2)
    assert len(a) == len(crowd) - 1
    assert set(b) == {1}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3), (1, 2), (2, 1)]
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert roots == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(200, 260)}, 2: 1}
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none).collect() == []
