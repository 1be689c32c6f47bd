"""How far the sources of a language are from each other, and by which words.

A probability, in parts of a billion, follows from how often a source has a
term, so what two sources differ by depends on how many terms have each pair of
counts in them. Columns that say, by 1 or 0, whether a source has a term so many
times, multiplied by their transpose, hold just these numbers: the joint tables
of all pairs of sources at once. Terms go to blocks; in a block they are ordered
by how often they occur, so that the terms of a product have few different
counts, and each cell of its joint tables is priced once. All arithmetic is in
integers, or in floats that hold integers exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import ship_package, whole_text
from logtide.llm.quality_rules import terms
from logtide.sources.storage import broadcast_if_small, settled

#: Documents of its language a term is in at least.
LEAST_DOCUMENTS = 3
#: Parts that probabilities are counted in, and what is added to every count.
SCALE = 1_000_000_000
ADDED = 1
#: Terms a source is told by.
TOP_TERMS = 200
#: Counts (terms times sources) of a block, about.
BLOCK_CELLS = 1 << 18
#: Terms and indicator columns of a product at most; sources that meet in one.
PRODUCT_TERMS = 8_192
PRODUCT_COLUMNS = 1_024
PRODUCT_SOURCES = 64

#: Counted terms before they leave a task.
_HELD = 400_000


def probabilities(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * n_terms))``, exactly."""
    whole = total + ADDED * n_terms
    if counts.size == 0 or int(counts.max()) + ADDED < 2**63 // SCALE:
        return 1 + SCALE * (counts + ADDED) // whole
    exact = [1 + SCALE * (int(c) + ADDED) // whole for c in counts.ravel()]
    return np.array(exact, np.int64).reshape(counts.shape)


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)``; the square of a billion fits 64 bits."""
    return (p - q) ** 2 // q


def _columns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of some terms: a matrix of 0 and 1, and the source and count of each column."""
    found = [np.unique(own, return_inverse=True) for own in counts.T]
    sizes = [len(levels) for levels, _ in found]
    starts = np.cumsum([0, *sizes[:-1]])
    ones = np.zeros((len(counts), sum(sizes)), np.float32)
    rows = np.arange(len(counts))
    for start, (_, which) in zip(starts, found, strict=True):
        ones[rows, start + which] = 1
    return ones, np.repeat(np.arange(len(sizes)), sizes), np.concatenate([levels for levels, _ in found])


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of terms few enough, and with few enough different counts, for one product."""
    waiting = [(0, len(counts))]
    while waiting:
        low, high = waiting.pop()
        own = counts[low:high]
        if high - low > 1 and (
            high - low > PRODUCT_TERMS or sum(len(np.unique(c)) for c in own.T) > PRODUCT_COLUMNS
        ):
            middle = (low + high) // 2
            waiting += [(middle, high), (low, middle)]
        elif high > low:
            yield low, high


def pair_values(counts: np.ndarray, totals: list[int], n_terms: int) -> np.ndarray:
    """For each two sources (columns of ``counts``), the prices of all terms summed.

    A product of indicator columns has sums of at most ``PRODUCT_TERMS`` ones,
    which 32-bit floats hold exactly. It is made for blocks of sources, so a
    language of many sources does not need one matrix of all.
    """
    n = counts.shape[1]
    found = np.zeros((n, n), np.int64)
    ordered = counts[np.argsort(-counts.sum(axis=1), kind="stable")]
    tiles = [np.arange(at, min(n, at + PRODUCT_SOURCES)) for at in range(0, n, PRODUCT_SOURCES)]
    for place, tile in enumerate(tiles):
        for other in tiles[place:]:
            both = tile if other is tile else np.r_[tile, other]
            for low, high in _runs(ordered[:, both]):
                ones, source, level = _columns(ordered[low:high][:, both])
                p = np.empty(len(level), np.int64)
                for at, name in enumerate(both):
                    p[source == at] = probabilities(level[source == at], totals[name], n_terms)
                left = source < len(tile)
                right = left if other is tile else ~left
                joint = ones[:, left].T @ ones[:, right]
                i, j = np.nonzero(joint)
                times = joint[i, j].astype(np.int64)
                i, j = np.flatnonzero(left)[i], np.flatnonzero(right)[j]
                np.add.at(found, (both[source[i]], both[source[j]]), times * prices(p[i], p[j]))
                if other is not tile:
                    np.add.at(found, (both[source[j]], both[source[i]]), times * prices(p[j], p[i]))
    return found


def _counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term in a group, and documents with it.

    A task adds up what it reads before it sends it, a bounded number of terms
    at a time. Every group has a row of the term '', also one without terms.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            langs, sources, names, times, documents = [], [], [], [], []
            for (lang, source), (n, own) in held.items():
                langs += [lang] * len(own)
                sources += [source] * len(own)
                names += [term.decode() for term in own]
                times += map(n.__getitem__, own)
                documents += own.values()
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.string()) for c in (langs, sources, names)),
                    *(pa.array(c, pa.int64()) for c in (times, documents)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
                n, own = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(own)
                found = Counter(terms(text.as_py().encode()))
                n.update(found)
                own.update([b"", *found])
                size += len(own) - before
                if size > _HELD:
                    yield flushed()
                    held, size = {}, 0
        yield flushed()

    return docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """``(lang, term, sources, counts)`` of the terms a language keeps, and ``(lang, source)`` of all groups.

    ``docs`` has ``lang``, ``source`` and ``text``. A term meets its sources in
    one row, as long as the list of the sources that have it.
    """
    spark = docs.sparkSession
    # Partial sums are dealt once, by language and term, for both groupings.
    dealt = _counted(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = (
        summed.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
        # Groups are the holders of the term ''.
        .where((F.col("docs") >= least_documents) | (F.col("term") == ""))
        .select("lang", "term", F.col("held.source").alias("sources"), F.col("held.n").alias("counts"))
    )
    kept = settled(spark, kept, "audit-terms")
    groups = kept.where(F.col("term") == "").select("lang", F.explode("sources").alias("source"))
    return kept.where(F.col("term") != ""), groups


_VALUES = "lang string, source string, part string, item string, value long"


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: what sets the sources of a language apart.

    Part ``pair`` has a row for each other source of the language, with how far
    the source is from it. Part ``term`` has the ``top_terms`` terms the source
    has more often than its language, by how far. Values are integers and exact;
    ties go by the bytes of the item.

    Null texts, languages and sources are ''. A language whose texts have no
    term in ``least_documents`` documents has pairs of value 0; one of a single
    source has no pairs. Repeated rows count each, texts are read whole, other
    columns are not read, and an empty table gives no rows.

    Terms are shuffled as partial sums, and a block of ``block_cells`` counts
    meets the list of its language's sources, whose pairs are the result. It
    gives one value per pair and its ``top_terms`` best terms per source, so no
    group of rows grows with the input.
    """
    spark = docs.sparkSession
    ship_package(spark)
    empty = lambda column: F.coalesce(F.col(column), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), whole_text(text).alias("text"))
    kept, groups = kept_terms(rows, least_documents)

    own = kept.select("lang", F.inline(F.arrays_zip("sources", "counts")))
    totals = own.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    langs = (
        groups.join(totals, ["lang", "source"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
        .join(sizes, "lang", "left")
        .select(
            "lang",
            F.col("groups.source").alias("names"),
            F.col("groups.total").alias("totals"),
            F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        )
    )
    cells = F.col("n_terms") * F.size("names")
    langs = settled(spark, langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(cells / block_cells))), "audit-langs")
    blocks = langs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = kept.join(broadcast_if_small(langs.select("lang", "blocks")), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "sources", "counts"
    )

    def priced(language: pa.Table, block: pa.Table) -> pa.Table:
        (facts,) = language.to_pylist()
        names, totals, n_terms = facts["names"], facts["totals"], facts["n_terms"]
        number = {name: i for i, name in enumerate(names)}
        block = block.combine_chunks()
        items = block.column("term").to_pylist()
        counts = np.zeros((len(items), len(names)), np.int64)
        lists = block.column("sources").combine_chunks()
        holders = np.array([number[s] for s in lists.flatten().to_pylist()], np.int64)
        of = np.repeat(np.arange(len(items)), lists.value_lengths().to_numpy(zero_copy_only=False))
        counts[of, holders] = block.column("counts").combine_chunks().flatten().to_numpy()

        between = pair_values(counts, totals, n_terms)
        i, j = np.nonzero(~np.eye(len(names), dtype=bool))
        found = [([names[a] for a in i], "pair", [names[b] for b in j], between[i, j])]

        by_bytes = np.argsort(np.array([item.encode() for item in items], object)) if items else np.empty(0, np.int64)
        order = np.empty(len(items), np.int64)
        order[by_bytes] = np.arange(len(items))
        q = probabilities(counts.sum(axis=1), sum(totals), n_terms)
        for at, name in enumerate(names):
            p = probabilities(counts[:, at], totals[at], n_terms)
            more = np.flatnonzero((counts[:, at] > 0) & (p > q))
            value = prices(p[more], q[more])
            best = np.lexsort((order[more], -value))[:top_terms]
            found.append(([name] * len(best), "term", [items[t] for t in more[best]], value[best]))
        parts = [
            pa.table(
                {
                    "lang": pa.array([facts["lang"]] * len(value), pa.string()),
                    "source": pa.array(sources, pa.string()),
                    "part": pa.array([part] * len(value), pa.string()),
                    "item": pa.array(own_items, pa.string()),
                    "value": pa.array(value, pa.int64()),
                }
            )
            for sources, part, own_items, value in found
        ]
        return pa.concat_tables(parts)

    keys = ["lang", "block"]
    left = blocks.select(*keys, "names", "totals", "n_terms")
    right = dealt.withColumnsRenamed({"lang": "of_lang", "block": "of_block"})
    found = left.groupBy(*keys).cogroup(right.groupBy("of_lang", "of_block")).applyInArrow(priced, _VALUES)
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # A term is in one block; a pair has a value from each.
    return (
        found.groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(place))
        .where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
    )
