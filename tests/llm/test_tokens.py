"""Token counts, byte-level BPE and token files against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from logtide.llm import bpe, token_counts, token_files
from logtide.llm.perfect_hash import PerfectHash
from tests.llm import edges

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _by_row(found) -> list[tuple]:
    return sorted((tuple(r) for r in found.collect()), key=repr)


def _expected(of_text) -> list[tuple]:
    return sorted(((r[0], *of_text(r[1] or "")) for r in edges.rows()), key=repr)


# -- token counts


def test_pieces_have_the_tokens_of_the_text():
    draw, model = random.Random(1), token_counts.load_model(PIECES)
    for text in edges.random_texts(draw, 500):
        pieces = token_counts.safe_pieces(text, draw.choice([0, 1, 5, 30]))
        assert sum(len(model.encode(p)) for p in pieces) == len(model.encode(text)), text


def test_batches_are_balanced_and_whole():
    sizes = [5, 1, 1, 90, 3, 3, 3]
    runs = list(token_counts.balanced_batches(sizes, 7))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 7 or b == a + 1 for a, b in runs)


def test_counts_match_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def of_text(text):
        n = len(model.encode(text))
        return len(text.encode()), n, n > 100

    found = token_counts.count_tokens(edges.documents(spark), PIECES, 100)
    assert [f.name for f in found.schema] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert _by_row(found) == _expected(of_text)


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(edges.no_documents(spark), PIECES, 100).collect() == []


# -- byte-level BPE


def _encoding() -> tiktoken.Encoding:
    return bpe.load_encoding(RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 40])
def test_reduction_gives_the_library_ids(leaf):
    encoding = _encoding()
    for text in edges.random_texts(random.Random(leaf), 300):
        ids = bpe.encode_text(encoding, text, leaf)
        assert ids.tolist() == encoding.encode_ordinary(text), text
        assert bpe.decode_ids(encoding, ids, 3) == text.encode()


def test_join_is_associative():
    encoding, draw = _encoding(), random.Random(4)
    for text in edges.random_texts(draw, 100):
        a, b = sorted(draw.randint(0, len(text)) for _ in range(2))
        x, y, z = (bpe.reduce_text(encoding, text, s, e) for s, e in ((0, a), (a, b), (b, len(text))))
        left = bpe.join(encoding, text, bpe.join(encoding, text, x, y), z)
        right = bpe.join(encoding, text, x, bpe.join(encoding, text, y, z))
        assert np.concatenate(left.ids).tolist() == np.concatenate(right.ids).tolist()


def test_digests_and_round_trip(spark):
    encoding = _encoding()

    def of_text(text):
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    docs = edges.documents(spark)
    assert _by_row(bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN)) == _expected(of_text)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    texts = sorted(((r.doc_id, bytes(r.decoded)) for r in decoded.collect()), key=repr)
    assert texts == sorted(((r[0], (r[1] or "").encode()) for r in edges.rows()), key=repr)


def test_bpe_of_nothing(spark):
    none = edges.no_documents(spark)
    assert bpe.round_trip_digests(none, RANKS, public_tokenizers.PATTERN).collect() == []


# -- token files


def test_words_have_the_ids_of_the_text():
    words = token_files.load_words(WORDS)
    for text in edges.random_texts(random.Random(2), 1500):
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.of_text(text) == array(words.code, ids).tobytes(), text


def test_letters_are_encoded_once_whatever_marks_stand_beside_them(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 12)
    monkeypatch.setattr(token_files, "KEPT_RUNS", 12, raising=False)
    words, asked = token_files.WordIds(WORDS), []

    class Model:
        def tokenize(self, run, model=words.model):
            asked.append(run)
            return model.tokenize(run)

    words.model = Model()
    long = "über" * 30
    for n in range(40):
        # The table is dropped every few texts; letters in use stay.
        text = f"Ümlaut{'!' * n} {long} ({'x' * n}y) It's\x1c {long} É{'?' * n}"
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.of_text(text) == array(words.code, ids).tobytes(), text
        text = f"Ümlaut{'?' * n} {long} ({'z' * n}y)\x0b{long} É{'!' * n}"
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.of_text(text) == array(words.code, ids).tobytes(), text
    byte_level = {"ü": "Ã¼"}
    assert asked.count("ümlaut".translate(str.maketrans(byte_level))) == 1
    # Long words are kept while their text is at hand.
    assert asked.count(long.translate(str.maketrans(byte_level))) == 80


@pytest.mark.parametrize("n", [0, 1, 2, 70, 3000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    built = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(built.numbers(keys)) == list(range(len(keys)))


@pytest.mark.parametrize("range_rows, shard_bytes", [(3, 100), (1000, 1 << 20)])
def test_files_give_back_what_went_in(spark, tmp_path, range_rows, shard_bytes):
    out = str(tmp_path / "files")
    token_files.write(
        edges.documents(spark), out, WORDS, 1, range_rows=range_rows, shard_bytes=shard_bytes
    )
    tokenizer = Tokenizer.from_file(WORDS)
    expected, start = [], 0
    for key, text, *_ in sorted(edges.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_files.read_digests(spark, out).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected

    wanted = spark.createDataFrame([(4,), (8,), (99,), (-5,), (None,), (4,)], "doc_id long")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.lookup(spark, out, wanted).collect()}
    texts = dict((r[0], r[1]) for r in edges.rows()[:9])
    assert got == {
        k: tokenizer.encode(texts[k], add_special_tokens=False).ids + [1] for k in (4, 8)
    }


def test_files_of_nothing(spark, tmp_path):
    out = str(tmp_path / "files")
    token_files.write(edges.no_documents(spark), out, WORDS, 1)
    assert token_files.read_digests(spark, out).collect() == []
