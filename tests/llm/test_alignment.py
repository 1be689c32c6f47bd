"""Token alignment against both libraries over whole texts, and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logtide.llm import alignment, queries
from logtide.llm.token_counts import safe_pieces
from tests.llm import edges

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _byte_of() -> dict[str, int]:
    """The usual table of byte-level tokenizers, the other way round."""
    printed = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def plain():
    """``groups(text)``: lists of A and B ids by group, from the libraries and whole texts."""
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    byte_of = _byte_of()

    def groups(text: str | None) -> list[tuple[list[int], list[int]]]:
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        found, own_a, own_b, at, done_a, done_b = [], [], [], 0, 0, 0
        for i, data in zip(ids_a, bytes_a, strict=True):
            own_a.append(i)
            done_a += len(data)
            while at < len(ids_b) and done_b < done_a:
                own_b.append(ids_b[at])
                done_b += len(bytes_b[at])
                at += 1
            if done_a == done_b:
                found.append((own_a, own_b))
                own_a, own_b = [], []
        return found

    return groups


def _expected(docs: list[tuple], groups) -> list[tuple]:
    found = [groups(r[1]) for r in docs]
    links = [Counter((a, b) for own_a, own_b in g for a in own_a for b in own_b) for g in found]
    held = Counter(pair for own in links for pair in own)
    highest: dict = {}
    for (a, _), n in held.items():
        highest[a] = max(n, highest.get(a, 0))
    rows = []
    for row, own, pairs in zip(docs, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        rows.append(
            (
                row[0],
                sum(len(a) for a, _ in own),
                sum(len(b) for _, b in own),
                len(own),
                pairs.total(),
                sum(n for (a, b), n in pairs.items() if held[a, b] == highest[a]),
                sum(n * held[pair] for pair, n in pairs.items()),
                hashlib.sha256(text.encode()).hexdigest() if own else "",
            )
        )
    return sorted(rows, key=repr)


def _found(frame) -> list[tuple]:
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_random_texts(plain, seed, monkeypatch):
    """Small rows, pieces and memory, so that every seam is met."""
    monkeypatch.setattr(alignment, "ROW_WORDS", 5)
    monkeypatch.setattr(alignment, "KEPT_WORDS", 40)
    monkeypatch.setattr(alignment, "LINKS", 6)
    monkeypatch.setattr(alignment, "safe_pieces", lambda text: safe_pieces(text, 30))
    texts = edges.random_texts(random.Random(seed), 400) + [t for t in edges.TEXTS if t and len(t) < 100_000]
    aligner = alignment.Aligner(PATH_A, PATH_B)
    assert aligner.a.direct
    for text, found in zip(texts, aligner.align_all(texts), strict=True):
        own = plain(text)
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        assert found.groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if own else ""), text
        links = Counter(a * aligner.n_ids_b + b for own_a, own_b in own for a in own_a for b in own_b)
        assert dict(zip(found.pairs.tolist(), found.times.tolist(), strict=True)) == links, text
        assert (found.n_a, found.n_b) == (sum(len(a) for a, _ in own), sum(len(b) for _, b in own))
        assert (found.n_groups, found.n_links) == (len(own), links.total())


def test_a_slice_of_very_many_links(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 50)
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 9, 300) * 100, draw.integers(0, 30, 200)
    pairs, times = alignment.linked_pairs(a, b, np.array([2, 290, 300]), np.array([1, 190, 200]))
    cuts = [((0, 2), (0, 1)), ((2, 290), (1, 190)), ((290, 300), (190, 200))]
    expected = Counter(int(x + y) for (i, j), (k, m) in cuts for x in a[i:j] for y in b[k:m])
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == expected
    assert np.all(np.diff(pairs) > 0)


def test_whole_texts_of_all_documents(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert _found(queries.op12_token_alignment(spark, SF_DIR)) == _expected(docs, plain)


@pytest.mark.parametrize("block_pairs", [1, 400, 10**6])
def test_awkward_rows(spark, plain, block_pairs):
    docs = edges.documents(spark)
    found = alignment.align_documents(docs, PATH_A, PATH_B, block_pairs=block_pairs)
    assert _found(found) == _expected(edges.rows(), plain)


def test_nothing(spark):
    assert alignment.align_documents(edges.no_documents(spark), PATH_A, PATH_B).collect() == []
    empty = spark.createDataFrame([(1, None), (None, ""), (2, "▁")], "doc_id long, text string")
    found = alignment.align_documents(empty, PATH_A, PATH_B)
    assert _found(found) == sorted([(1, *[0] * 6, ""), (None, *[0] * 6, ""), (2, *[0] * 6, "")], key=repr)
