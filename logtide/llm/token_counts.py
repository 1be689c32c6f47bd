"""Token counts of whole texts by a sentencepiece model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import ship_package, whole_text

#: Characters of a text piece, and of the pieces encoded in one call.
PIECE_CHARS = 32_768
BATCH_BYTES = 1 << 20

# A space between a letter or digit and a character that is no white space.
_SAFE_CUT = re.compile(r"(?<=[^\W_]) (?=[^\s▁])")


@lru_cache(maxsize=2)
def load_model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, checked for what safe cuts rely on.

    No piece has a space mark after another character, so no token spans the
    place between a character and the space behind it. And a single space at
    the front of a text is what the model puts there by itself.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    if any("▁" in piece.lstrip("▁") for piece in pieces):
        raise ValueError(f"{path}: a piece spans a word's end")
    if model.encode("a b") != model.encode("a") + model.encode("b"):
        raise ValueError(f"{path}: the model adds no space in front of a text")
    return model


def safe_pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text cut into pieces whose tokens together are those of the text.

    A cut takes the space it is made at, which the model adds to the next
    piece again. Where no safe cut exists, a piece grows to the next one.
    """
    pieces, start = [], 0
    while len(text) - start > most:
        cut = _SAFE_CUT.search(text, start + most)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.end()
    pieces.append(text[start:])
    return pieces


def balanced_batches(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of pieces of about ``most`` bytes; a larger piece is one by itself."""
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def text_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; the ids themselves are dropped batch by batch."""
    model = load_model(path)
    pieces: list[str] = []
    owners: list[int] = []
    for owner, text in enumerate(texts):
        own = safe_pieces(text)
        pieces += own
        owners += [owner] * len(own)
    totals = [0] * len(texts)
    for start, end in balanced_batches([len(p.encode()) for p in pieces]):
        encoded = model.encode(pieces[start:end], num_threads=1)
        for owner, ids in zip(owners[start:end], encoded, strict=True):
            totals[owner] += len(ids)
    return totals


def count_tokens(
    docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    Tokens are those of the sentencepiece model at ``path`` for the whole text,
    without begin or end tokens. A null text counts as empty and has no bytes
    and no tokens; a null key stays null; equal and repeated rows each give a
    row; a text of any length is cut only where tokens cannot span. Other
    columns of ``docs`` are not read. Only lengths leave Python, and no row
    leaves its partition.
    """
    ship_package(docs.sparkSession)

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(text_lengths(batch.to_pylist(), path), pa.int64())

    n_tokens = F.arrow_udf(lengths, "long")
    return docs.select(
        F.col(key),
        F.octet_length(whole_text(text)).cast("long").alias("n_bytes"),
        n_tokens(whole_text(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
