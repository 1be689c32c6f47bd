"""Byte-level BPE encoding and decoding as a tree reduction over text segments.

A segment stands for its characters and their ids. Segments form a monoid:
joining two keeps the ids on either side of a window around the seam and
encodes the window anew. The window grows on both sides until it begins and
ends at places every split of the text passes through, so that the ids outside
cannot depend on what is across the seam.

Such a place is a space behind a letter or digit. No match of the pattern holds
a space behind another character, so matches end there in any scan, and no
match before it looks further than the space itself. Ids of different matches
never touch.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import ship_package, whole_text

#: Segments up to so many characters are encoded as they are.
LEAF_CHARS = 16_384
#: Ids up to so many are decoded as they are.
LEAF_IDS = 65_536
#: Characters of the first window on either side of a seam.
WINDOW = 64

_SETTLED = re.compile(r"(?<=[^\W_]) ")


@lru_cache(maxsize=2)
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Segment:
    """Characters ``start`` to ``end`` of a text, and their ids as a list of arrays."""

    start: int
    end: int
    ids: list[np.ndarray]

    def dropped(self, n: int, front: bool) -> list[np.ndarray]:
        """The ids without the first or last ``n``."""
        parts = list(self.ids)
        while n:
            at = 0 if front else -1
            part = parts[at]
            if len(part) <= n:
                n -= len(part)
                parts.pop(at)
            else:
                parts[at] = part[n:] if front else part[:-n]
                n = 0
        return parts


def _encode(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.asarray(encoding.encode_ordinary(text), dtype="<u4")


def _settled_before(text: str, segment: Segment) -> int:
    """The last settled place inside a segment, or its start."""
    width = WINDOW
    while True:
        # One character more, for the letter in front of the space.
        low = max(segment.start, segment.end - width)
        found = [m.start() for m in _SETTLED.finditer(text, max(segment.start, low - 1), segment.end)]
        found = [at for at in found if at > segment.start]
        if found:
            return found[-1]
        if low == segment.start:
            return segment.start
        width *= 4


def _settled_after(text: str, segment: Segment) -> int:
    """The first settled place inside a segment, or its end."""
    width = WINDOW
    while True:
        high = min(segment.end, segment.start + width)
        found = _SETTLED.search(text, segment.start + 1, high)
        if found:
            return found.start()
        if high == segment.end:
            return segment.end
        width *= 4


def join(encoding: tiktoken.Encoding, text: str, left: Segment, right: Segment) -> Segment:
    """The segment of two neighbours; only a window around the seam is encoded."""
    if left.start == left.end or right.start == right.end:
        return Segment(left.start, right.end, left.ids + right.ids)
    low, high = _settled_before(text, left), _settled_after(text, right)
    # Both cuts are settled places, so these are the ids the segments have there.
    tail = len(encoding.encode_ordinary(text[low : left.end]))
    head = len(encoding.encode_ordinary(text[right.start : high]))
    window = _encode(encoding, text[low:high])
    ids = [*left.dropped(tail, front=False), window, *right.dropped(head, front=True)]
    return Segment(left.start, right.end, ids)


def reduce_text(
    encoding: tiktoken.Encoding, text: str, start: int, end: int, leaf: int = LEAF_CHARS
) -> Segment:
    if end - start <= leaf:
        return Segment(start, end, [_encode(encoding, text[start:end])])
    middle = (start + end) // 2
    left = reduce_text(encoding, text, start, middle, leaf)
    right = reduce_text(encoding, text, middle, end, leaf)
    return join(encoding, text, left, right)


def encode_text(encoding: tiktoken.Encoding, text: str, leaf: int = LEAF_CHARS) -> np.ndarray:
    """All ids of a text, as little-endian unsigned 32-bit integers."""
    parts = reduce_text(encoding, text, 0, len(text), leaf).ids
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, "<u4"), *parts])


def decode_ids(encoding: tiktoken.Encoding, ids: np.ndarray, leaf: int = LEAF_IDS) -> bytes:
    """The bytes the ids stand for: halves decoded and concatenated."""
    if len(ids) <= leaf:
        return encoding.decode_bytes(ids.tolist())
    middle = len(ids) // 2
    return decode_ids(encoding, ids[:middle], leaf) + decode_ids(encoding, ids[middle:], leaf)


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, ids)`` of every row; ``ids`` holds little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids; a null key stays null; equal
    and repeated rows each give a row; texts of any length are encoded whole.
    Other columns of ``docs`` are not read, and no row leaves its partition.
    """
    ship_package(docs.sparkSession)

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(path, pattern)
        for batch in batches:
            ids = [encode_text(encoding, text.as_py()).tobytes() for text in batch]
            yield pa.array(ids, pa.binary())

    return docs.select(F.col(key), F.arrow_udf(ids_of, "binary")(whole_text(text)).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``(key, decoded)`` of rows as ``encode`` gives them; ``decoded`` is binary UTF-8."""
    ship_package(encoded.sparkSession)

    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(path, pattern)
        for batch in batches:
            found = [decode_ids(encoding, np.frombuffer(ids.as_py(), "<u4")) for ids in batch]
            yield pa.array(found, pa.binary())

    return encoded.select(F.col(key), F.arrow_udf(bytes_of, "binary")("ids").alias("decoded"))


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, its ids decoded.

    Encodes and decodes as ``encode`` and ``decode`` do, with the same results
    for nulls, empty, repeated and long texts, but lets only digests leave
    Python.
    """
    ship_package(docs.sparkSession)

    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(path, pattern)
        for batch in batches:
            rows = []
            for text in batch:
                ids = encode_text(encoding, text.as_py())
                decoded = decode_ids(encoding, ids)
                rows.append(
                    {
                        "n_tokens": len(ids),
                        "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
                        "decoded_sha256": hashlib.sha256(decoded).hexdigest(),
                    }
                )
            yield pa.array(rows, kind)

    kind = pa.struct(
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    found = F.arrow_udf(digests, schema)(whole_text(text)).alias("found")
    return docs.select(F.col(key), found).select(key, "found.*")
