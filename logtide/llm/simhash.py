"""Near-duplicates by SimHash: tiles of fingerprints compared exactly.

Fingerprints that differ in at most ``radius`` bits differ by no more in the
number of bits set, as a whole and summed over the quarters. So fingerprints go
to cells by the bit counts of their four quarters, cells are cut into tiles,
and only tiles of cells whose counts are within the radius are compared, every
fingerprint of one with every one of the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import ship_package, whole_text
from logtide.llm.components import connected_components
from logtide.sources.storage import settled

#: Words of a shingle, and the seed of its hash.
SHINGLE_WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
RADIUS = 2
#: Fingerprints of a tile, about.
TILE_ROWS = 2048
#: Shingles hashed before their bits are added up.
BLOCK = 1 << 15

_QUARTERS = 4
_COUNTS = 17  # bits set in a quarter: 0 to 16


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles as rows of 8 bytes, block by block.

    Fewer words than a shingle has are one shingle; no words give none.
    """
    width = min(width, len(words))
    total = len(words) - width + 1 if words else 0
    digest = xxhash.xxh64_digest
    for start in range(0, total, BLOCK):
        own = words[start : start + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(own[i:] for i in range(width)), strict=False))
        yield np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed integer."""
    total, set_in = 0, np.zeros(64, dtype=np.int64)
    for hashes in blocks:
        total += len(hashes)
        set_in += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > total).tobytes(), "big", signed=True)


def fingerprint(text: str) -> int:
    """The 64 bits that are set in over half of the shingles' hashes, as a signed integer.

    A text of fewer words than a shingle has is one shingle, and a text without
    words has the fingerprint 0. Long texts are hashed block by block.
    """
    # Bytes are put in lower case, and split, as ASCII.
    return majority(shingle_hashes(text.encode().lower().split(), SHINGLE_WORDS))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, bits)`` of every row; a null text counts as empty."""
    ship_package(docs.sparkSession)

    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(text.as_py()) for text in batch], pa.int64())

    return docs.select(F.col(key), F.arrow_udf(bits, "long")(whole_text(text)).alias("bits"))


def _quarter_counts() -> list[Column]:
    return [
        F.bit_count(F.shiftrightunsigned("bits", 16 * q).bitwiseAND(0xFFFF)).cast("int")
        for q in range(_QUARTERS)
    ]


def _cell(counts: list[Column]) -> Column:
    cell = F.lit(0)
    for count in counts:
        cell = cell * _COUNTS + count
    return cell


def _near_cells(cell: Column, radius: int) -> Column:
    """The cell and those after it whose counts differ by no more than the radius."""
    counts = [
        F.floor(cell / _COUNTS ** (_QUARTERS - 1 - q)).cast("int") % _COUNTS
        for q in range(_QUARTERS)
    ]
    near = []
    for step in product(range(-radius, radius + 1), repeat=_QUARTERS):
        if sum(map(abs, step)) > radius or step < (0,) * _QUARTERS:
            continue
        moved = [count + by for count, by in zip(counts, step, strict=True)]
        exists = F.lit(True)
        for count in moved:
            exists = exists & count.between(0, _COUNTS - 1)
        near.append(F.when(exists, _cell(moved)))
    return F.array_compact(F.array(*near))


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the close pairs of two tiles (or of one) connect.

    All pairs are compared. Within a tile pair every fingerprint is then linked
    to the smallest it is connected with, so a crowd of copies gives as many
    links as it has members and not one for each pair.
    """
    one, other = (a, a) if b is None else (a, b)
    # Of signed integers, numpy would count the bits of the absolute value.
    apart = np.bitwise_count((one[:, None] ^ other[None, :]).view(np.uint64))
    left, right = np.nonzero(apart <= radius)
    keep = one[left] != other[right]
    left, right = left[keep], right[keep]
    if not len(left):
        return left, right
    nodes, places = np.unique(np.concatenate([one[left], other[right]]), return_inverse=True)
    ends = places.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ends[0]], label[ends[1]])
        better = label.copy()
        np.minimum.at(better, ends[0], low)
        np.minimum.at(better, ends[1], low)
        better = better[better]
        if np.array_equal(better, label):
            break
        label = better
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def close_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints within the radius of each other.

    ``distinct`` has one row for each value of ``bits``. There are 17^4 = 83,521
    cells at most, whatever the number of documents, so the table of cells is
    bounded and broadcast. A cell with many fingerprints has many tiles; each
    pair of tiles is a row of its own and goes to the task of its second tile.
    """
    spark = distinct.sparkSession
    ship_package(spark)
    placed = distinct.select("bits", _cell(_quarter_counts()).alias("cell"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n"))
    cells = settled(spark, cells, "simhash-cells")
    tiles = (
        placed.join(F.broadcast(cells), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("bits"), F.col("n")).cast("int"))
        .groupBy("cell", "tile")
        .agg(F.collect_list("bits").alias("values"))
    )
    tiles = settled(spark, tiles, "simhash-tiles")

    near = cells.select("cell", "n", F.explode(_near_cells(F.col("cell"), radius)).alias("other"))
    others = cells.select(F.col("cell").alias("other"), F.col("n").alias("other_n"))
    tile_numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = (
        near.join(F.broadcast(others), "other")
        .withColumn("tile", tile_numbers("n"))
        .withColumn("other_tile", tile_numbers("other_n"))
        .where((F.col("cell") < F.col("other")) | (F.col("tile") <= F.col("other_tile")))
        .select("cell", "tile", "other", "other_tile")
    )
    second = tiles.select(
        F.col("cell").alias("other"),
        F.col("tile").alias("other_tile"),
        F.col("values").alias("other_values"),
    )
    is_self = (F.col("cell") == F.col("other")) & (F.col("tile") == F.col("other_tile"))
    compared = (
        pairs.join(tiles, ["cell", "tile"])
        .join(second, ["other", "other_tile"])
        .select("values", F.when(~is_self, F.col("other_values")).alias("other_values"))
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                tile_links(
                    one.values.to_numpy(),
                    other.values.to_numpy() if other.is_valid else None,
                    radius,
                )
                for one, other in zip(batch.column(0), batch.column(1), strict=True)
            ]
            columns = [np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column.astype(np.int64)) for column in columns or ([], [])], ["a", "b"]
            )

    return compared.mapInArrow(links, "a long, b long")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row.

    ``fingerprint`` has 16 hexadecimal digits. Fingerprints within ``radius``
    bits are linked, and ``component_id`` is the smallest key reachable over
    links, the row's own included. Texts without words, null ones too, have the
    fingerprint 0 and are linked like any other. Null keys stay null and are
    no component's smallest unless it has no other. Equal texts and repeated
    rows share a fingerprint, which is compared once, however many rows have it.
    Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = settled(spark, fingerprints(docs, key, text), "simhash-rows")
    values = rows.groupBy("bits").agg(F.min(key).alias("least"))
    values = settled(spark, values, "simhash-values")
    roots = connected_components(close_links(values.select("bits"), radius))
    rooted = (
        values.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
        .select("bits", F.coalesce("root", "bits").alias("root"), "least")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("bits", "root").join(smallest, "root").select("bits", "component_id")
    return rows.join(named, "bits").select(
        F.col(key),
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
    )
