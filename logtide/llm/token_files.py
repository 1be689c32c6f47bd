"""Documents as token ids in shards with a keyed index.

A shard is one row of a Parquet table, so that any store Spark reaches can hold
it: documents in ascending key order with their raw ids as the payload, and a
minimal perfect hash from keys to slots. A slot has a fingerprint of its key,
and the place and number of its ids in the payload.

Columns: ``range`` and ``seq`` order the shards; ``first`` and ``last`` are the
smallest and largest key (as sort keys); ``keys`` are the keys in order, 8 bytes
each, ``nulls`` how many at the front are null; ``salt`` seeds the key hash;
``hash`` is the perfect hash; ``prints`` (4 bytes), ``places`` and ``lengths``
(8 bytes) are the slots; ``width`` is the bytes of an id; ``ids`` is the payload,
little-endian. A second table, ``starts``, has the number of ids before each
shard.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logtide.llm.common import (
    range_number,
    range_starts,
    running_totals,
    ship_package,
    sort_key,
    whole_text,
)
from logtide.llm.perfect_hash import PerfectHash, mixed

#: Bytes of a shard's payload, about; a longer document is a shard by itself.
SHARD_BYTES = 4 << 20
#: Words and runs of words whose ids a task keeps (twice), and the longest of them.
KEPT_WORDS = 400_000
KEPT_BYTES = 64
#: Documents of a key range, which one task writes.
RANGE_ROWS = 4_000
#: Bytes of a Parquet row group, so that a writer holds no more.
ROW_GROUP_BYTES = 16 << 20

# All plain characters, alone and between others.
_PLAIN_CHARACTERS = [chr(c) for c in [*range(33, 39), *range(40, 127), *range(192, 256)] if c not in (215, 247)]
_SAMPLE = " ".join(f"{c} x{c}y 5{c}{c}é" for c in _PLAIN_CHARACTERS)

_SHARD = pa.schema(
    [
        ("range", pa.int32()),
        ("seq", pa.int32()),
        ("first", pa.int64()),
        ("last", pa.int64()),
        ("n_ids", pa.int64()),
        ("keys", pa.binary()),
        ("nulls", pa.int64()),
        ("salt", pa.int64()),
        ("hash", pa.binary()),
        ("prints", pa.binary()),
        ("places", pa.binary()),
        ("lengths", pa.binary()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
    ]
)
_SHARD_DDL = (
    "range int, seq int, first long, last long, n_ids long, keys binary, nulls long, salt long, "
    "hash binary, prints binary, places binary, lengths binary, width int, ids binary"
)


# Runs of plain characters in lower case: letters of ASCII and Latin-1, digits,
# and other printable ASCII but for the apostrophe. No normalization joins them.
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-`{-~]+")
# Texts of plain characters, in any case, and white space.
_PLAIN_TEXT = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-`{-~ \t\n\r\x0b\x0c]*")


def _byte_characters() -> str:
    """What byte-level pre-tokenizers write for each of the 256 bytes.

    Bytes that print stand for themselves, the others for the characters from
    256 on, in their order.
    """
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [byte for byte in range(256) if byte not in printed]
    names = {byte: chr(byte) for byte in printed} | {b: chr(256 + n) for n, b in enumerate(moved)}
    return "".join(names[byte] for byte in range(256))


class _Kept(dict):
    """Ids by word; a word that is not there is asked for."""

    def __init__(self, ask: Callable[[bytes], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: bytes) -> bytes:
        return self.ask(word)


class WordIds:
    """Ids of words by a tokenizer, as bytes; those of short words are kept.

    The tokenizer drops white space, and neither its normalizer nor its split
    looks past it, so a text's ids are those of its words in a row. Words of
    plain characters go straight to the tokenizer's model, run by run, if that
    gives what the whole tokenizer gives. A run is kept like a word of its own,
    so the letters of a word are the same entry whatever marks stand beside them.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        last = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1)
        self.width = 2 if last < 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.packed = [array(self.code, [id_]).tobytes() for id_ in range(last + 1)]
        self.words: dict[bytes, bytes] = _Kept(self._ids)
        self.older: dict[bytes, bytes] = {}
        self.long: dict[bytes, bytes] = {}  # of the text at hand
        self.characters = _byte_characters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.lower().encode() for token in added]
        if any(len(content.split()) != 1 for content in self.added):
            raise ValueError(f"{path}: an added token holds white space")
        self.direct = True
        self.direct = all(self._by_runs(word) == self._whole(word) for word in _SAMPLE.split())
        self.words.clear()

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def _run(self, run: str) -> bytes:
        own = run if run.isascii() else charmap_decode(run.encode(), "strict", self.characters)[0]
        packed = self.packed
        return b"".join([packed[token.id] for token in self.model.tokenize(own)])

    def _by_runs(self, word: str) -> bytes | None:
        """Ids of a word of plain characters alone; none for another."""
        low = word.lower()
        runs = _RUNS.findall(low)
        if len(runs) == 1 and runs[0] == word:
            return self._run(word)
        if "".join(runs) != low:
            return None
        words = self.words
        return b"".join([words[run.encode()] for run in runs])

    def _ids(self, word: bytes) -> bytes:
        kept, past = (self.words, self.older) if len(word) <= KEPT_BYTES else (self.long, self.long)
        # Words in use come back from the older half.
        found = past.get(word)
        if found is None and self.direct:
            found = self._by_runs(word.decode())
        if found is None:
            found = self._whole(word.decode())
        kept[word] = found
        return found

    def of_text(self, text: str) -> bytes:
        raw = text.encode()
        # The tokenizer puts words in lower case too, so fewer differ. Beyond plain
        # characters the order of its steps matters, and added tokens are found before.
        low = raw.lower()
        if any(content in low for content in self.added):
            return b"".join([self._whole(word.decode()) for word in raw.split()])
        if len(self.words) >= KEPT_WORDS:
            self.older, self.words = self.words, _Kept(self._ids)
        self.long.clear()
        plain = raw.isascii() or (self.direct and _PLAIN_TEXT.fullmatch(text))
        return b"".join(map(self.words.__getitem__, (low if plain else raw).split()))


@lru_cache(maxsize=1)
def load_words(path: str) -> WordIds:
    """A word table checked for what cutting at white space relies on."""
    words = WordIds(path)
    for text in ("It's  Café\n3.5 (x)\tÉ", "a b \x0bc"):
        whole = words.tokenizer.encode(text, add_special_tokens=False).ids
        if words.of_text(text) != array(words.code, whole).tobytes():
            raise ValueError(f"{path}: ids of a text are not those of its words")
    return words


def key_hashes(keys: np.ndarray, nulls: int, salt: int) -> np.ndarray:
    """Hashes of ascending keys, the first ``nulls`` of them null.

    The n-th row of an equal key counts as a key of its own.
    """
    at = np.arange(len(keys))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    if 0 < nulls < len(keys):
        fresh[nulls] = True
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return key_hash(keys, at < nulls, again, salt)


def key_hash(keys: np.ndarray, null: np.ndarray, again: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        named = mixed(keys.astype(np.int64).view(np.uint64), salt)
        return mixed(named + again.astype(np.uint64) + null.astype(np.uint64) * np.uint64(1 << 63), salt + 1)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes, 1 << 20) >> np.uint64(32)).astype("<u4")


def shard_row(number: int, seq: int, keys: list, ids: list[bytes], width: int) -> dict:
    """A shard of documents in ascending key order; ``None`` is the smallest key."""
    nulls = sum(key is None for key in keys)
    places = np.array([-(2**63) if key is None else key for key in keys], dtype=np.int64)
    lengths = np.array([len(i) // width for i in ids], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    salt = 0
    while len(np.unique(hashes := key_hashes(places, nulls, salt))) < len(hashes):
        salt += 1
    perfect = PerfectHash.build(hashes)
    slots = perfect.numbers(hashes)
    slot_of = np.empty((3, len(keys)), np.int64)
    slot_of[:, slots] = _prints(hashes), starts, lengths
    return {
        "range": number,
        "seq": seq,
        "first": int(places[0]),
        "last": int(places[-1]),
        "n_ids": int(lengths.sum()),
        "keys": places.astype("<i8").tobytes(),
        "nulls": nulls,
        "salt": salt,
        "hash": perfect.to_bytes(),
        "prints": slot_of[0].astype("<u4").tobytes(),
        "places": slot_of[1].astype("<u8").tobytes(),
        "lengths": slot_of[2].astype("<u8").tobytes(),
        "width": width,
        "ids": b"".join(ids),
    }


class Shard:
    """Keyed access to a shard's row."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.nulls, self.salt = row["nulls"], row["salt"]
        self.perfect = PerfectHash.from_bytes(row["hash"])
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.places = np.frombuffer(row["places"], "<u8").astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u8").astype(np.int64)
        self.ids = np.frombuffer(row["ids"], f"<u{row['width']}")

    def all_hashes(self) -> np.ndarray:
        return key_hashes(self.keys, self.nulls, self.salt)

    def hashes(self, keys: list) -> np.ndarray:
        places = np.array([-(2**63) if key is None else key for key in keys], dtype=np.int64)
        null = np.array([key is None for key in keys], dtype=bool)
        return key_hash(places, null, np.zeros(len(keys), np.int64), self.salt)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint tells that it has none."""
        slots = self.perfect.numbers(hashes)
        if not len(self.prints):
            return np.full(len(hashes), -1)
        return np.where((slots >= 0) & (self.prints[slots] == _prints(hashes)), slots, -1)

    def ids_at(self, slot: int) -> np.ndarray:
        start = self.places[slot]
        return self.ids[start : start + self.lengths[slot]].astype("<u4")


def write(
    docs: DataFrame,
    out: str,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    range_rows: int = RANGE_ROWS,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode all texts and write them in ascending key order to ``out``.

    Ids are those of the tokenizer file at ``path`` without special tokens, and
    ``end_id`` follows each document. A null text counts as empty and has the
    end id alone; null keys come first; rows of equal keys follow each other by
    text. An empty table gives empty tables. Other columns are not read. Texts
    are shuffled once, by ranges of keys that hold about ``range_rows`` rows; a
    task writes the shards of its ranges as it encodes and holds one at a time.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    starts = range_starts(rows.select(sort_key("key").alias("place")), "place", range_rows)
    # Each range is one task's, and the shuffle leaves its tasks to the session.
    ordered = (
        rows.withColumn("range", range_number(sort_key("key"), starts).cast("int"))
        .repartition("range")
        .sortWithinPartitions("range", "key", "text")
        .select("range", "key", "text")
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_words(path)
        # Encoding makes many objects and no cycles.
        gc.disable()
        try:
            yield from shards_of(batches, words)
        finally:
            gc.enable()

    def shards_of(batches: Iterator[pa.RecordBatch], words: WordIds) -> Iterator[pa.RecordBatch]:
        end = array(words.code, [end_id]).tobytes()
        number, seq, keys, ids, held = None, 0, [], [], 0

        def full() -> pa.RecordBatch:
            row = shard_row(number, seq, keys, ids, words.width)
            return pa.RecordBatch.from_pylist([row], _SHARD)

        for batch in batches:
            ranges, own_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for own, key_, text_ in zip(ranges, own_keys, batch.column(2), strict=True):
                found = words.of_text(text_.as_py()) + end
                if keys and (own != number or held + len(found) > shard_bytes):
                    yield full()
                    seq, keys, ids, held = seq + 1 if own == number else 0, [], [], 0
                elif own != number:
                    seq = 0
                number = own
                keys.append(key_)
                ids.append(found)
                held += len(found)
        if keys:
            yield full()

    written = ordered.mapInArrow(shards, _SHARD_DDL).write
    written.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{out}/shards")
    sizes = spark.read.schema(_SHARD_DDL).parquet(f"{out}/shards").select("range", "seq", "first", "n_ids")
    total = running_totals(sizes, F.col("range"), ["seq"], {"n_ids": "total"})
    before = total.select("range", "seq", "first", (F.col("total") - F.col("n_ids")).alias("start"))
    before.write.parquet(f"{out}/starts")


def _shards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_SHARD_DDL).parquet(f"{out}/shards")


def _starts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("range int, seq int, first long, start long").parquet(f"{out}/starts")


_DIGESTS = pa.schema(
    [
        ("range", pa.int32()),
        ("seq", pa.int32()),
        ("key", pa.int64()),
        ("place", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def read_digests(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of all documents, from the files alone.

    Every document is looked up by its key in its shard's index. ``start`` is
    the number of ids of all documents before it; the checksum is over the ids
    as little-endian unsigned 32-bit integers, end id included.
    """
    ship_package(spark)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                entry = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                shard = Shard(entry)
                slots = shard.slots(shard.all_hashes())
                if (slots < 0).any():
                    raise ValueError("a key is missing from its shard's index")
                n = len(slots)
                null = np.arange(n) < shard.nulls
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, entry["range"], np.int32)),
                        pa.array(np.full(n, entry["seq"], np.int32)),
                        pa.array(shard.keys, mask=null),
                        pa.array(shard.places[slots]),
                        pa.array(shard.lengths[slots]),
                        pa.array([zlib.crc32(shard.ids_at(slot).tobytes()) for slot in slots], pa.int64()),
                    ],
                    schema=_DIGESTS,
                )

    found = _shards(spark, out).mapInArrow(
        digests, "range int, seq int, key long, place long, n_tokens long, ids_crc32 long"
    )
    return found.join(_starts(spark, out), ["range", "seq"]).select(
        F.col("key").alias(key), (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, out: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` of those keys the files have; ids as little-endian 32-bit integers.

    Keys go to the shards whose key range holds them, and each shard is read by
    one task, which finds a key in constant time. Of rows with equal keys the
    first is found. Keys that are null or not in the files give no row.
    """
    ship_package(spark)
    first = _starts(spark, out).groupBy("range").agg(F.min("first").alias("first"))
    starts = [r["first"] for r in first.orderBy("range").collect()]
    wanted = keys.select(F.col(key).cast("long").alias("key")).where(F.col("key").isNotNull()).distinct()
    wanted = wanted.withColumn("range", range_number(F.col("key"), starts).cast("int"))
    shards = _shards(spark, out)
    asked = (
        wanted.join(shards.select("range", "seq", "first", "last"), "range")
        .where(F.col("key").between(F.col("first"), F.col("last")))
        .groupBy("range", "seq")
        .agg(F.collect_list("key").alias("asked"))
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                entry = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                shard = Shard(entry)
                slots = shard.slots(shard.hashes(entry["asked"]))
                got = [(k, shard.ids_at(s).tobytes()) for k, s in zip(entry["asked"], slots, strict=True) if s >= 0]
                columns = [pa.array([k for k, _ in got], pa.int64()), pa.array([i for _, i in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids"])

    found = shards.join(asked, ["range", "seq"]).mapInArrow(find, "key long, ids binary")
    return found.select(F.col("key").alias(key), "ids")
