"""Tokens of two tokenizers aligned by the bytes they cover.

Both tokenizers cut the same bytes. The ends of their tokens, as running sums of
token lengths, are the keys of two dictionaries that give the token they end.
Ends that both have are the intersection of the keys; in order, they slice both
id lists into groups that cover the same bytes. Within a slice each token of one
is linked to each of the other.

No token of either spans the place between a character and a space behind it, so
a text is aligned word by word, and a task keeps what it knows of words.

How many documents hold a pair of ids linked is counted over the whole corpus.
Documents travel in blocks: a block knows its distinct pairs and, for each
document, which of them it holds how often. So a pair is shuffled once per block
that has it, however often its documents do, and one in every document is a row
per block and no more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logtide.llm.common import ship_package, whole_text
from logtide.llm.token_counts import balanced_batches, load_model, safe_pieces
from logtide.sources.storage import settled

#: Pairs (distinct ones of each document) in a block, about.
BLOCK_PAIRS = 1_500_000
#: Links expanded at a time.
LINKS = 1 << 20
#: Words a task keeps the alignment of, and characters of all of them.
KEPT_WORDS = 250_000
KEPT_CHARS = 16 << 20
#: Words encoded in a row.
ROW_WORDS = 4_096

# Text whose split does not depend on a Unicode version: printable ASCII, line
# ends and tabs, and the letters of Latin-1.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[ -~\\n\\t\\r{_LETTERS}]*")
_SPACES = r"[ \n\t\r]+"
_MARKS = r"[!-/:-@\[-`{-~]+"
_WORD = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?{_MARKS}|{_SPACES}(?![^ \n\t\r])|{_SPACES}"
)
# A single space between characters that are none.
_CUT = re.compile(f"(?<=[!-~{_LETTERS}]) (?=[!-~{_LETTERS}])|(?<=[^\\W_]) (?=[^\\s▁])")
_BORDERS = re.compile(f"[!-~{_LETTERS}]{{1,2}}")
_SAMPLE = "It's  we'll\n\n an été: 12,345 <|endoftext|> a\t\tb \r\n--x-- 'D naïve!? don't\n end  "


def byte_characters() -> list[str]:
    """The character that byte-level tokenizers write for each byte.

    Bytes that print stand for themselves, the others for the characters from
    256 on, in their order.
    """
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = count(256)
    return [chr(byte if byte in printed else next(moved)) for byte in range(256)]


class ByteLevel:
    """Ids of texts by a byte-level tokenizer; special strings are plain text.

    Plain text is split here and goes straight to the tokenizer's model, if that
    gives what the whole tokenizer gives; other text goes through all of it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        characters = byte_characters()
        own = [*range(128), *range(0xC0, 0x100)]
        self.names = {c: "".join(characters[b] for b in chr(c).encode()) for c in own if c}
        byte_of = {name: byte for byte, name in enumerate(characters)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [b""] * size
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.tokens[number] = bytes(byte_of[c] for c in token)
        whole = self.tokenizer.encode(_SAMPLE, add_special_tokens=False).ids
        self.direct = self._by_words(_SAMPLE) == whole

    def _by_words(self, text: str) -> list[int]:
        # All words go through the table of names at once.
        words = "\0".join(_WORD.findall(text)).translate(self.names).split("\0")
        return [token.id for word in words for token in self.model.tokenize(word)]

    def ids(self, text: str) -> list[int]:
        if self.direct and _PLAIN.fullmatch(text):
            return self._by_words(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: a byte piece's byte, else its characters with marks as spaces."""
    found = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            found.append(bytes([int(piece[3:5], 16)]))
        else:
            found.append(piece.replace("▁", " ").encode())
    return found


_NOTHING = np.empty(0, np.int64)


@dataclass
class Aligned:
    """What a document's tokens give: numbers, groups, and its distinct pairs with their links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups_sha256: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def common_cuts(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Behind how many tokens of either the groups end, in order."""
    end_a = dict(zip(lengths_a.cumsum().tolist(), count(1)))
    end_b = dict(zip(lengths_b.cumsum().tolist(), count(1)))
    common = sorted(end_a.keys() & end_b.keys())
    cuts_a = np.fromiter(map(end_a.__getitem__, common), np.int64, len(common))
    cuts_b = np.fromiter(map(end_b.__getitem__, common), np.int64, len(common))
    return cuts_a, cuts_b


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def linked_pairs(
    first: np.ndarray, last: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sums of a number of A and one of B in a slice, and how many links each has.

    Links are expanded slice by slice, a bounded number at a time; a slice with
    more links than that is expanded over its distinct numbers.
    """
    start_a, start_b = np.r_[0, cuts_a[:-1]], np.r_[0, cuts_b[:-1]]
    n_b = cuts_b - start_b
    links = (cuts_a - start_a) * n_b
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    small = np.flatnonzero(links <= LINKS)
    # Runs of slices that have a bounded number of links together.
    run = (np.cumsum(links[small]) - 1) // LINKS
    for groups in np.split(small, np.flatnonzero(np.diff(run)) + 1):
        own = links[groups]
        group = np.repeat(groups, own)
        place = np.arange(len(group)) - np.repeat(np.cumsum(own) - own, own)
        keys = first[start_a[group] + place // n_b[group]] + last[start_b[group] + place % n_b[group]]
        parts.append(summed(keys, np.ones(len(keys), np.int64)))
    for group in np.flatnonzero(links > LINKS):
        a, of_a = np.unique(first[start_a[group] : cuts_a[group]], return_counts=True)
        b, of_b = np.unique(last[start_b[group] : cuts_b[group]], return_counts=True)
        step = max(1, LINKS // len(b))
        for at in range(0, len(a), step):
            keys = (a[at : at + step, None] + b[None, :]).ravel()
            parts.append((keys, (of_a[at : at + step, None] * of_b[None, :]).ravel()))
    return summed(*map(np.concatenate, zip(*parts, strict=True)))


class Aligner:
    """Aligns texts by a byte-level tokenizer (A) and a sentencepiece model (B).

    What is known of a word is kept under its number: its tokens and groups, the
    ids of its groups as text (none where tokens do not give its bytes again),
    and its distinct pairs ``a * n_ids_b + b`` with their links, from
    ``starts[number]`` to ``starts[number + 1]``.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a = ByteLevel(path_a)
        self.b = load_model(path_b)
        self.bytes_a, self.bytes_b = self.a.tokens, piece_bytes(self.b)
        self.n_ids_b = len(self.bytes_b)
        self.length_a = np.array([len(t) for t in self.bytes_a])
        self.length_b = np.array([len(t) for t in self.bytes_b])
        # What is written for an id that goes on in its group, and for one that ends it.
        self.written = [b"%d%c" % (i, end) for i in range(len(self.bytes_a)) for end in b",|"]
        self.offset = len(self.written)
        self.written += [b"%d%c" % (i, end) for i in range(self.n_ids_b) for end in b",;"]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: list[bytes | None] = []
        self.counts = np.empty((0, 3), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.held = 0

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of both for words in a row, and how many each word has; none if bytes differ."""
        text = f" {' '.join(words)}"
        list_a, list_b = self.a.ids(text), self.b.encode(text[1:])
        whole = text.encode()
        for tokens, ids in ((self.bytes_a, list_a), (self.bytes_b, list_b)):
            if b"".join(map(tokens.__getitem__, ids)) != whole:
                return None
        ends = np.cumsum([len(word.encode()) + 1 for word in words])
        found = []
        for ids, length in ((np.array(list_a), self.length_a), (np.array(list_b), self.length_b)):
            token_ends = np.cumsum(length[ids])
            last = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[last], ends):
                return None
            found += [ids, np.diff(last, prepend=-1)]
        return tuple(found)

    def learn(self, words: list[str]) -> None:
        """Align new words, all of them in one go, as if they were one text.

        Words that begin and end in plain characters are encoded in rows, others
        alone. So are those of a row whose tokens don't give its bytes again.
        """
        plain = [word for word in words if _BORDERS.fullmatch(word[:1] + word[-1:])]
        in_rows = set(plain)
        others = [[word] for word in words if word not in in_rows]
        words = plain + [word for row in others for word in row]
        parts, good = [], []
        for row in [*(plain[at : at + ROW_WORDS] for at in range(0, len(plain), ROW_WORDS)), *others]:
            whole = self._tokens(row)
            alone = whole is None and len(row) > 1
            for own in map(self._tokens, ([word] for word in row)) if alone else [whole]:
                n = 1 if alone else len(row)
                parts.append(own or (_NOTHING, np.zeros(n, np.int64), _NOTHING, np.zeros(n, np.int64)))
                good += [own is not None] * n
        ids_a, sizes_a, ids_b, sizes_b = (np.concatenate(p).astype(np.int64) for p in zip(*parts, strict=True))
        cuts_a, cuts_b = common_cuts(self.length_a[ids_a], self.length_b[ids_b])

        # A's ids come before B's in a group, behind those of both in the groups before.
        n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        parts = np.empty(len(ids_a) + len(ids_b), np.int64)
        place_a = np.arange(len(ids_a)) + np.repeat(cuts_b - n_b, n_a)
        place_b = np.arange(len(ids_b)) + np.repeat(cuts_a, n_b)
        parts[place_a] = 2 * ids_a
        parts[place_b] = 2 * ids_b + self.offset
        parts[place_a[cuts_a - 1]] += 1
        parts[place_b[cuts_b - 1]] += 1
        written = list(map(self.written.__getitem__, parts.tolist()))
        ends = np.cumsum(sizes_a + sizes_b).tolist()
        self.texts += [
            b"".join(written[start:end])[:-1] if ok else None
            for start, end, ok in zip([0, *ends], ends, good, strict=False)
        ]

        # The number of a word goes in front of its pairs.
        every_pair = len(self.bytes_a) * self.n_ids_b
        owner = np.repeat(np.arange(len(words)), sizes_a)
        keys, times = linked_pairs(owner * every_pair + ids_a * self.n_ids_b, ids_b, cuts_a, cuts_b)
        per_word = np.bincount(keys // every_pair, minlength=len(words))
        groups = np.bincount(owner[cuts_a - 1], minlength=len(words))
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(per_word)]
        self.pairs, self.times = np.r_[self.pairs, keys % every_pair], np.r_[self.times, times]
        self.counts = np.concatenate([self.counts, np.stack([sizes_a, sizes_b, groups], axis=1)])
        self.numbers.update(zip(words, count(len(self.numbers))))
        self.held += sum(map(len, words))

    def pairs_of(self, numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of some words, each so many times, and the links of each."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        place = np.arange(n.sum()) + np.repeat(self.starts[numbers] - np.cumsum(n) + n, n)
        return summed(self.pairs[place], self.times[place] * np.repeat(times, n))

    def align_all(self, texts: list[str]) -> Iterator[Aligned]:
        """Each text in turn; an empty one has no tokens."""
        pieces = [(owner, piece) for owner, text in enumerate(texts) if text for piece in safe_pieces(text)]
        found = [Aligned() for _ in texts]
        hashes = [hashlib.sha256() if text else None for text in texts]
        for start, end in balanced_batches([len(piece.encode()) for _, piece in pieces]):
            own = [(owner, _CUT.split(piece)) for owner, piece in pieces[start:end]]
            if len(self.numbers) > KEPT_WORDS or self.held > KEPT_CHARS:
                self.forget()
            new = {word: None for _, words in own for word in words if word not in self.numbers}
            if new:
                self.learn(list(new))
            for owner, words in own:
                if hashes[owner] is None:
                    continue
                numbers = list(map(self.numbers.__getitem__, words))
                written = list(map(self.texts.__getitem__, numbers))
                if None in written:
                    hashes[owner], found[owner] = None, Aligned()
                    continue
                distinct, times = np.unique(np.array(numbers), return_counts=True)
                counts = times @ self.counts[distinct]
                doc = found[owner]
                pairs, links = self.pairs_of(distinct, times)
                if doc.n_a:
                    hashes[owner].update(b";")
                    pairs, links = summed(np.r_[doc.pairs, pairs], np.r_[doc.times, links])
                hashes[owner].update(b";".join(written))
                doc.n_a, doc.n_b, doc.n_groups = (
                    have + int(more) for have, more in zip((doc.n_a, doc.n_b, doc.n_groups), counts, strict=True)
                )
                doc.pairs, doc.times = pairs, links
        for doc, digest in zip(found, hashes, strict=True):
            if digest is not None:
                doc.groups_sha256 = digest.hexdigest()
            doc.n_links = int(doc.times.sum())
            yield doc


@lru_cache(maxsize=1)
def load_aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _block(number: int, keys: list[pa.Array], docs: list[Aligned], schema: pa.Schema) -> pa.RecordBatch:
    """A block as one row.

    ``pairs`` are its distinct pairs in order and ``holders`` how many documents
    hold each. ``places`` (steps from one to the next) and ``times`` are, document
    after document, the pairs a document holds and its links of each.
    """
    sizes = np.array([len(d.pairs) for d in docs], np.int64)
    every = np.concatenate([d.pairs for d in docs])
    times = np.concatenate([d.times for d in docs])
    pairs, places, holders = np.unique(every, return_inverse=True, return_counts=True)
    steps = np.diff(places.astype("<i4"), prepend=np.int32(0))
    one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
    columns = [
        pa.array([number]),
        one(pa.concat_arrays(keys)),
        *(one(pa.array([getattr(d, name) for d in docs], pa.int64())) for name in _NUMBERS),
        one(pa.array([d.groups_sha256 for d in docs], pa.string())),
        one(pa.array(sizes)),
        one(pa.array(pairs)),
        one(pa.array(holders.astype(np.int64))),
        pa.array([_packed(steps)], pa.binary()),
        pa.array([_packed(times.astype("<i8"))], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def align_blocks(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``(id, text)`` rows as blocks of aligned documents; a task reads its rows once, in order."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ", ".join(f"{name} array<long>" for name in _NUMBERS)
    ddl = (
        f"block long, ids array<{kind}>, {names}, groups_sha256 array<string>, sizes array<long>, "
        "pairs array<long>, holders array<long>, places binary, times binary"
    )
    lists = [*_NUMBERS, "groups_sha256", "sizes", "pairs", "holders"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        found: list[Aligned] = []
        held, schema = 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            schema = pa.schema(
                [
                    ("block", pa.int64()),
                    ("ids", pa.list_(id_type)),
                    *((n, pa.list_(pa.string() if n == "groups_sha256" else pa.int64())) for n in lists),
                    ("places", pa.binary()),
                    ("times", pa.binary()),
                ]
            )
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for at, aligned in enumerate(aligner.align_all(texts)):
                keys.append(ids.slice(at, 1))
                found.append(aligned)
                held += len(aligned.pairs)
                if held >= block_pairs:
                    yield _block(number, keys, found, schema)
                    number, keys, found, held = number + 1, [], [], 0
        if found:
            yield _block(number, keys, found, schema)

    return docs.mapInArrow(blocks, ddl)


def align_documents(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    key: str = "doc_id",
    text: str = "text",
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Per row ``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    ``path_a`` names a byte-level tokenizer, which gets a space in front of a
    text, and ``path_b`` a sentencepiece model, which adds one itself. ``n_best``
    are the links whose pair is in as many documents as any pair of its A id,
    and ``count_sum`` adds up, over the links, in how many documents their pair
    is. ``groups_sha256`` is the digest of the ids of all groups.

    A null or empty text has no tokens, nor has one whose tokens do not give its
    bytes again (the model takes some characters for spaces): its numbers are 0,
    its digest is '' and it counts for no pair. A null key stays null, each
    repeated row counts as a document, a text of any length is aligned in pieces,
    other columns are not read, and an empty table gives no rows.

    No text is shuffled. A block holds a bounded number of pairs, or one
    document; joins are over distinct pairs of blocks. The table of highest
    counts has a row per A id, so its size is bounded by the vocabulary, and it
    is broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    blocks = settled(spark, align_blocks(rows, path_a, path_b, block_pairs), "aligned-blocks")
    n_ids_b = load_model(path_b).get_piece_size()

    of_blocks = blocks.select("block", F.inline(F.arrays_zip("pairs", "holders")))
    of_blocks = of_blocks.select("block", F.col("pairs").alias("pair"), "holders")
    counts = settled(spark, of_blocks.groupBy("pair").agg(F.sum("holders").alias("n")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {n_ids_b}L"))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    known = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    asked = of_blocks.select("block", "pair").join(known, "pair")

    kind = rows.schema["id"].dataType.simpleString()
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    ddl = ", ".join([f"id {kind}", *(f"{name} long" for name in order[:-1]), "groups_sha256 string"])

    def weighed(block: pa.Table, pairs: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        row = {name: block.column(name).combine_chunks() for name in block.column_names}
        sizes = row["sizes"].flatten().to_numpy()
        total = int(sizes.sum())
        by_pair = np.argsort(pairs.column("pair").to_numpy())
        places = np.cumsum(_unpacked(row["places"][0].as_py(), total, "<i4"), dtype=np.int64)
        times = _unpacked(row["times"][0].as_py(), total, "<i8")
        weight = pairs.column("n").to_numpy()[by_pair][places] * times
        best = np.where(pairs.column("best").to_numpy()[by_pair][places], times, 0)
        ends = np.cumsum(sizes)
        per_doc = lambda values: np.diff(np.r_[0, np.cumsum(values)][np.r_[0, ends]])
        columns = {"n_best": pa.array(per_doc(best)), "count_sum": pa.array(per_doc(weight))}
        lists = [row["ids"].flatten(), *(columns[n] if n in columns else row[n].flatten() for n in order)]
        return pa.Table.from_arrays(lists, ["id", *order])

    own = blocks.drop("pairs", "holders").withColumnRenamed("block", "number")
    found = own.groupBy("number").cogroup(asked.groupBy("block")).applyInArrow(weighed, ddl)
    return found.select(F.col("id").alias(key), *order)
