"""Quality rules: repetition counts, and divergence from what a language looks like.

A language's reference is made of all its documents: the share of each class of
characters, and of its most common words. A document is compared with the
references by Jensen-Shannon distance. Word salad, tables, spam in capitals and
symbol noise use other characters or other common words than prose does.

What two histograms of the same text differ by chance shrinks with the length
of the sample, so that much is taken off a divergence first, and texts below a
minimum length are not judged at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import ship_package, whole_text
from logtide.sources.storage import settled

#: The base rule: words a document has at least, and percent of them in repeated windows at most.
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW_WORDS = 3
SYMBOLS = b"#*$%&|<>"
#: Common words of a language, beside which all other words are one bin.
COMMON_WORDS = 100
#: Characters and terms from which a text is judged.
LEAST_CHARS = 200
LEAST_TERMS = 50
#: A language has a reference if it has so many documents, and one in so many of all.
LEAST_DOCUMENTS = 20
LEAST_SHARE = 200
#: Terms and characters up to which a document weighs by its length in a reference.
FULL_WEIGHT = 1_000
#: Jensen-Shannon distances above which a document is rejected.
CLASS_LIMIT = 0.19
WORD_LIMIT = 0.25
#: Parts of a bit by which divergences are put in order when the nearer half is looked for.
STEPS = 1_000

#: Words counted before they leave a task, and numbers of a block of histograms.
_HELD_WORDS = 200_000
_BLOCK = 1 << 21

# Character classes, by the first byte of a character: small and capital letters,
# digits, blanks, line ends and the like, marks of prose, other marks, control
# characters, Latin letters beyond ASCII, everything else.
CLASSES = 10
_CLASS = np.full(256, 255, np.uint8)
_CLASS[:32], _CLASS[127] = 7, 7
_CLASS[33:127] = 6
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[32] = 3
_CLASS[9:14] = 4
_CLASS[list(b".,;:'\"()!?-")] = 5
_CLASS[0xC2:0xCC] = 8  # U+0080 to U+02FF
_CLASS[0xCC:0xF5] = 9

# Letters are kept in lower case, bytes beyond ASCII as they are, all else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_chars long, n_terms long, classes array<long>, words array<long>, counts array<long>"
)


def terms(data: bytes) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return data.translate(_LETTERS).split()


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(ids) - width + 1
    keys = ids[:n]
    for at in range(1, width):
        if len(number) ** (at + 1) >= 2**63:
            # Pairs are numbered anew where they would not fit 64 bits.
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(number) + ids[at : at + n]
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    inside = np.zeros(len(ids), bool)
    for at in range(width):
        inside[at : at + n] |= twice
    return int(inside.sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int, bool]:
    """Words, their characters, symbols, repeated lines, repeated words, and whether these fail."""
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    characters = sum(map(len, words)) - sum(map(_continued, words))
    return (
        len(words),
        characters,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words),
    )


def _continued(word: bytes) -> int:
    """Bytes that only continue a character."""
    return 0 if word.isascii() else len(word) - len(word.decode())


def class_counts(data: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=256)[:CLASSES]


def _language(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """For each language that gets a reference, its most common terms.

    ``docs`` has ``lang`` and ``text``. A word counts once per document, and
    documents of ``LEAST_TERMS`` terms or more count. Ties go by bytes. A
    language has at least one in ``LEAST_SHARE`` of the documents, which bounds
    what reaches the driver, whatever the size of the table.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        rows = 0

        def flushed() -> pa.RecordBatch:
            flat = [(lang, word.decode(), n) for lang, own in held.items() for word, n in own.items()]
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            types = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "word", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                found = terms(text.as_py().encode())
                if len(found) < LEAST_TERMS:
                    continue
                own = held.setdefault(lang.as_py(), Counter())
                before = len(own)
                # The empty word counts the documents.
                own.update({b"", *found})
                rows += len(own) - before
                if rows > _HELD_WORDS:
                    yield flushed()
                    held, rows = {}, 0
        yield flushed()

    counts = docs.select("lang", "text").mapInArrow(counted, "lang string, word string, n long")
    counts = settled(
        docs.sparkSession, counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "common-words"
    )
    sizes = counts.where(F.col("word") == "").select("lang", F.col("n").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    known = sizes.join(F.broadcast(total)).where(
        (F.col("size") >= LEAST_DOCUMENTS) & (F.col("size") * LEAST_SHARE >= F.col("total"))
    )
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    # At most LEAST_SHARE languages of COMMON_WORDS words.
    best = (
        counts.where(F.col("word") != "")
        .join(F.broadcast(known.select("lang")), "lang")
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= COMMON_WORDS)
        .orderBy("lang", "place")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in best:
        found.setdefault(row["lang"], []).append(row["word"])
    return found


def features(docs: DataFrame, common: dict[str, list[str]], key: str) -> DataFrame:
    """Base counts and histograms of every row: ``(key, lang, ...)``.

    ``words`` and ``counts`` hold the terms that are common in any language, by
    their number in the order of languages and words.
    """
    number: dict[bytes, int] = {}
    for words in common.values():
        for word in words:
            number.setdefault(word.encode(), len(number))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, classes, words, counts, n_chars, n_terms = [], [], [], [], [], []
            for text in batch.column("text"):
                data = text.as_py().encode()
                base.append(base_counts(data))
                own = class_counts(data)
                classes.append(own)
                n_chars.append(int(own.sum()))
                found = Counter(terms(data))
                n_terms.append(found.total())
                known = sorted((number[w], n) for w, n in found.items() if w in number)
                words.append([w for w, _ in known])
                counts.append([n for _, n in known])
            integers = pa.list_(pa.int64())
            columns = [
                *(batch.column(c) for c in ("id", "lang")),
                *(pa.array(c, pa.int64()) for c in list(zip(*base, strict=True))[:5] or [[]] * 5),
                pa.array([b[5] for b in base], pa.bool_()),
                pa.array(n_chars, pa.int64()),
                pa.array(n_terms, pa.int64()),
                pa.array([c.tolist() for c in classes], integers),
                pa.array(words, integers),
                pa.array(counts, integers),
            ]
            names = ["id", "lang", *(part.split()[0] for part in _FEATURES.split(", "))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("id"), "lang", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(measured, f"id {kind}, lang string, {_FEATURES}")


@dataclass
class References:
    """What each language looks like: sums over the bins of both histograms."""

    common: dict[str, list[str]]
    classes: dict[str, np.ndarray]
    words: dict[str, np.ndarray]

    @property
    def languages(self) -> list[str]:
        return [lang for lang in self.common if lang in self.words]


def word_numbers(common: dict[str, list[str]]) -> tuple[int, dict[str, np.ndarray]]:
    """How many different common words there are, and which are those of each language."""
    number: dict[str, int] = {}
    for words in common.values():
        for word in words:
            number.setdefault(word, len(number))
    return len(number), {lang: np.array([number[w] for w in words], np.int64) for lang, words in common.items()}


def _blocks(batch: pa.RecordBatch, n_numbers: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with their class counts, counts of common words, and terms."""
    rows = max(1, _BLOCK // max(1, n_numbers))
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        lists = part.column("words")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros((part.num_rows, n_numbers), np.int64)
        owners = np.repeat(np.arange(part.num_rows), sizes)
        counts[owners, lists.flatten().to_numpy()] = part.column("counts").flatten().to_numpy()
        classes = part.column("classes").flatten().to_numpy().reshape(-1, CLASSES)
        yield start, start + part.num_rows, classes, counts, part.column("n_terms").to_numpy()


def _with_others(counts: np.ndarray, own: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
    """The histogram of a language's common words, all other terms as the last bin."""
    common = counts[:, own]
    return np.concatenate([common, (n_terms - common.sum(axis=1))[:, None]], axis=1)


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, 0 to 1 bit, of each row from a reference.

    A row or a reference without anything has no distribution and is 0 apart.
    """
    total = counts.sum(axis=1, keepdims=True)
    if not reference.sum():
        return np.zeros(len(counts))
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0.0) + np.where(q > 0, q * np.log2(q / middle), 0.0)
    return np.where(total[:, 0] > 0, np.maximum(0.0, parts.sum(axis=1) / 2), 0.0)


def beyond_chance(found: np.ndarray, bins: int, n: np.ndarray) -> np.ndarray:
    """Distances left when what samples of ``n`` differ by on average is taken off."""
    chance = (bins - 1) / (8 * math.log(2) * np.maximum(n, 1))
    return np.sqrt(np.maximum(0.0, found - chance))


def _weighed(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts as integer weights: in all a document's length, and not over ``FULL_WEIGHT``."""
    n = np.maximum(n, 1)[:, None]
    return counts * (FULL_WEIGHT * np.minimum(n, FULL_WEIGHT)) // n


def _usable() -> Column:
    """Rows a reference is made of."""
    return ~F.col("base_failed") & (F.col("n_chars") >= LEAST_CHARS) & (F.col("n_terms") >= LEAST_TERMS)


def _summed(rows: DataFrame, common: dict[str, list[str]]) -> References:
    """References of rows of ``features``; a task sends one sum per language and bin."""
    n_numbers, own = word_numbers(common)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, end, classes, counts, n_terms in _blocks(batch, n_numbers):
                for lang in set(langs[start:end]) & set(own):
                    of = langs[start:end] == lang
                    words = _with_others(counts[of], own[lang], n_terms[of])
                    parts = [
                        _weighed(classes[of], classes[of].sum(axis=1)).sum(axis=0),
                        _weighed(words, n_terms[of]).sum(axis=0),
                    ]
                    before = held.get(lang)
                    held[lang] = parts if before is None else [a + b for a, b in zip(before, parts, strict=True)]
        flat = [
            (lang, kind, bin_, int(value))
            for lang, parts in held.items()
            for kind, part in enumerate(parts)
            for bin_, value in enumerate(part)
        ]
        columns = list(zip(*flat, strict=True)) or [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "kind", "bin", "value"]
        )

    partial = rows.mapInArrow(sums, "lang string, kind long, bin long, value long")
    found = partial.groupBy("lang", "kind", "bin").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    classes: dict[str, np.ndarray] = {}
    words: dict[str, np.ndarray] = {}
    for row in found:
        to, bins = (words, len(common[row["lang"]]) + 1) if row["kind"] else (classes, CLASSES)
        to.setdefault(row["lang"], np.zeros(bins))[row["bin"]] = float(row["value"])
    return References(common, classes, words)


def references(measured: DataFrame, common: dict[str, list[str]]) -> References:
    """References of all languages, from the half of their documents nearest to the average.

    A crowd of copies or of junk moves an average, but it is not what most of
    the other documents are near to: the average of the nearer half does not
    have it, as long as it is less than half of a language. The half is found
    over counts of documents by their divergence, in ``STEPS`` parts of a bit.
    """
    usable = measured.where(_usable())
    first = _summed(usable, common)
    n_numbers, own = word_numbers(common)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.full(batch.num_rows, -1, np.int64)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, end, classes, counts, n_terms in _blocks(batch, n_numbers):
                for lang in set(langs[start:end]) & set(first.languages):
                    of = np.flatnonzero(langs[start:end] == lang)
                    words = _with_others(counts[of], own[lang], n_terms[of])
                    apart = divergence(classes[of], first.classes[lang]) + divergence(words, first.words[lang])
                    step[start + of] = np.floor(STEPS * apart).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(step)], [*batch.schema.names, "step"])

    kept = ["lang", "n_terms", "classes", "words", "counts"]
    schema = "lang string, n_terms long, classes array<long>, words array<long>, counts array<long>, step long"
    placed = usable.select(*kept).mapInArrow(steps, schema).where(F.col("step") >= 0)
    placed = settled(usable.sparkSession, placed, "rule-steps")
    # 2 * STEPS + 1 counts of a language at most.
    by_step = Window.partitionBy("lang").orderBy("step")
    middle = (
        placed.groupBy("lang", "step")
        .agg(F.count("*").alias("n"))
        .withColumn("up_to", F.sum("n").over(by_step))
        .withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
        .where(F.col("up_to") * 2 >= F.col("all"))
        .groupBy("lang")
        .agg(F.min("step").alias("middle"))
    )
    nearer = placed.join(F.broadcast(middle), "lang").where(F.col("step") <= F.col("middle"))
    return _summed(nearer.select(*kept), common)


def judged(measured: DataFrame, known: References) -> DataFrame:
    """``measured`` with ``language``, ``class_distance`` and ``word_distance``.

    The language is the one whose common words are nearest, the first in order
    of code points if several are, and null where there is no reference. What a
    text that is too short, or has no reference, can't show is a distance of 0.
    """
    n_numbers, own = word_numbers(known.common)
    languages = sorted(known.languages)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest: list[str | None] = [None] * batch.num_rows
            by_class, by_word = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for start, end, classes, counts, n_terms in _blocks(batch, n_numbers) if languages else ():
                words = np.stack(
                    [divergence(_with_others(counts, own[lang], n_terms), known.words[lang]) for lang in languages]
                )
                each = np.arange(len(n_terms))
                best = words.argmin(axis=0)
                of_class = np.stack([divergence(classes, known.classes[lang]) for lang in languages])[best, each]
                bins = np.array([len(own[lang]) + 1 for lang in languages])[best]
                n_chars = classes.sum(axis=1)
                nearest[start:end] = [languages[b] for b in best]
                class_far = np.round(beyond_chance(of_class, CLASSES, n_chars), 6)
                word_far = np.round(beyond_chance(words[best, each], bins, n_terms), 6)
                by_class[start:end] = np.where(n_chars >= LEAST_CHARS, class_far, 0.0)
                by_word[start:end] = np.where(n_terms >= LEAST_TERMS, word_far, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(nearest, pa.string()),
                    pa.array(by_class, pa.float64()),
                    pa.array(by_word, pa.float64()),
                ],
                [*carried, "language", "class_distance", "word_distance"],
            )

    carried = [c for c in measured.columns if c not in ("lang", "n_chars", "n_terms", "classes", "words", "counts")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema if f.name in carried)
    return measured.mapInArrow(distances, f"{schema}, language string, class_distance double, word_distance double")


def apply_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Counts, distances and the verdict of every row.

    Per row: ``(key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, language, class_distance,
    word_distance)``. A row is kept if it passes the base rule and neither
    distance is above its limit; a text too short to be judged is 0 apart.

    A null text has no words, so it fails the base rule. A null language is a
    language of its own; it only says which reference a document adds to. Null
    keys stay null, equal texts get equal verdicts, repeated rows give a row
    each, texts are read whole, other columns are not read, and an empty table
    gives no rows. No text is shuffled: counts of words by language are, and
    sums by language and bin.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).alias("_key"), _language(lang).alias("lang"), whole_text(text).alias("text"))
    common = common_words(rows)
    measured = settled(spark, features(rows, common, "_key"), "rule-features")
    found = judged(measured, references(measured, common))
    near = (F.col("class_distance") <= CLASS_LIMIT) & (F.col("word_distance") <= WORD_LIMIT)
    return found.select(
        F.col("id").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        "language",
        "class_distance",
        "word_distance",
    )
