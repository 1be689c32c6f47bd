"""Document fingerprints from spot signatures, in built-in functions only.

A spot is a common word, the anchor, followed by a content word; its signature
is the anchor with the chain of the next content words, common words between
them left out. A document's fingerprint is its set of signatures. Navigation,
tables and word lists have few anchors, so prose decides what looks alike.

Sets are compared by Jaccard similarity. It can't exceed the smaller set's size
over the larger's, so sets are partitioned by length, and only lengths that can
reach the wanted similarity meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import range_number, range_starts, sort_key, whole_text
from logtide.sources.storage import settled

#: Content words of a chain.
CHAIN = 2
#: Similarity from which documents count as near-duplicates.
SIMILARITY = 0.8
#: Documents of a key range, whose texts meet in one task.
RANGE_ROWS = 2_000

#: Common words of English, German, French and Spanish.
ANCHORS = """
the of and to in a is that it was for on are as with they be at this have from or had by not but
what all were we when your can said there an which their if do will how about he she his her you
der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden
aus er hat dass sie nach wird bei einer um am sind noch wie einem über
de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec
son ont aux mais comme ou si leur elle deux même
el los las del se lo con su para al una por más pero sus este ya entre cuando muy sin sobre ser
tiene también me hasta hay donde
""".split()

_ANCHOR = f" (?=(?:{'|'.join(sorted(set(ANCHORS)))}) )"
_CONTENT = "[^# ][^ ]*+ "
# Runs of common words between content words are taken possessively: linear time.
_SPOT = f"(?=(#[^ ]++ {_CONTENT}(?:(?:#[^ ]++ )*+{_CONTENT}){{{CHAIN - 1}}}))"


def word_line(text: Column) -> Column:
    """Words (letters and digits) in lower case with a space before, between and after."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def with_signatures(rows: DataFrame, text: str, to: str) -> DataFrame:
    """``rows`` with the sorted set of signature hashes of a text column.

    A text without any spot has its whole sequence of words as its one
    signature, and a text without words has none. Each step is a column of its
    own, so that no expression is computed twice.
    """
    spots = F.regexp_extract_all(F.regexp_replace("_line", _ANCHOR, " #"), F.lit(_SPOT), F.lit(1))
    hashes = F.transform("_spots", lambda s: F.xxhash64(F.regexp_replace(s, "(?<= )#[^ ]+ ", "")))
    whole = F.when(F.col("_line") != "  ", F.array(F.xxhash64("_line")))
    return (
        rows.withColumn("_line", word_line(F.col(text)))
        .withColumn("_spots", spots)
        .withColumn("_hashes", F.sort_array(F.array_distinct(hashes)))
        .withColumn(
            to,
            F.when(F.size("_hashes") > 0, F.col("_hashes")).otherwise(
                F.coalesce(whole, F.array().cast("array<long>"))
            ),
        )
        .drop("_line", "_spots", "_hashes")
    )


def digest(sigs: Column) -> Column:
    """A signature set as text: its size and 128 bits, in hexadecimal."""
    parts = [F.hex(F.size(sigs)), F.hex(F.xxhash64(sigs)), F.hex(F.xxhash64(F.lit(1), sigs))]
    widths = (8, 16, 16)
    return F.lower(F.concat(*[F.lpad(p, w, "0") for p, w in zip(parts, widths, strict=True)]))


def length_bound(a: Column, b: Column) -> Column:
    """The most the similarity of two sets can be, from their lengths alone."""
    return F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two signature sets, pruned by length.

    Sets whose lengths rule out a similarity above 0, or one of ``least``, get 0
    without being intersected. Two empty sets are equal.
    """
    common = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((length_bound(a, b) == 0) | (length_bound(a, b) < least), 0.0)
        .when(a == b, 1.0)
        .otherwise(common / (F.size(a) + F.size(b) - common))
    )


def _with_next(docs: DataFrame, range_rows: int) -> DataFrame:
    """Rows ``(place, text)`` with the signatures, and those and the text of the next row.

    Rows go to ranges of their keys. The first row of a range is sent to the
    range before it as well, behind its last row, and the very first row to the
    last range. So each text is shuffled once.
    """
    starts = range_starts(docs, "place", range_rows)
    last = max(0, len(starts) - 1)
    own = range_number(F.col("place"), starts)
    is_first = F.get(F.lit(starts or [0]), F.col("_own")) == F.col("place")
    before = F.when(F.col("_own") == 0, last).otherwise(F.col("_own") - 1)
    stay = F.struct(F.col("_own").alias("range"), F.lit(False).alias("guest"))
    visit = F.struct(before.alias("range"), F.lit(True).alias("guest"))
    rows = with_signatures(
        docs.withColumn("_own", own)
        .withColumn("_at", F.explode(F.when(is_first, F.array(stay, visit)).otherwise(F.array(stay))))
        .select(*docs.columns, F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest"))
        .repartition("_range"),
        "text",
        "sigs",
    )
    order = Window.partitionBy("_range").orderBy("_guest", "place", "text")
    following = F.lead(F.struct("text", "sigs")).over(order)
    return rows.withColumn("next", following).where(~F.col("_guest")).drop("_range", "_guest")


def fingerprint_edits(
    docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Fingerprints of all texts, and of each with its second half exchanged.

    Per row: ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_signatures)``. The edited text is the text whose
    last ``floor(n_chars / 2)`` characters are replaced by as many from the
    front of the next document in key order (all it has, if fewer); the first
    follows the last. ``near_edited`` and ``near_next`` are the Jaccard
    similarities with the edited text and the next document.

    A null text counts as empty; null keys come first and rows of equal keys
    follow each other by text; a single row is its own next one. Texts without
    words have the empty set, which equals only the empty set. Other columns of
    ``docs`` are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), sort_key(key).alias("place"), whole_text(text).alias("text"))
    n_chars = F.char_length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = (F.col("n_chars") - half).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next.text"), F.lit(1), half)
    )
    pairs = _with_next(rows, range_rows).withColumn("n_chars", n_chars).withColumn("edited", edited)
    found = with_signatures(pairs, "edited", "edited_sigs")
    return found.select(
        F.col("id").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("sigs")).alias("fingerprint"),
        digest(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


def length_class(n: Column, similarity: float) -> Column:
    """Partition of a set length: lengths that can reach the similarity are at most one apart."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / -math.log(similarity) + 1e-9)).otherwise(-1)


def similar_pairs(
    docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """All pairs of different signature sets of at least this similarity.

    Returns ``(key, fingerprint)`` of every row, and ``(a, b, similarity)`` of
    fingerprints, ``a < b``. Documents of equal sets share a fingerprint and are
    compared once, so copies give no pairs. Sets meet over their rarest
    signatures (as many as a similar set can't all lack) inside a partition of
    set lengths; lengths and the places of the shared signature prune candidates
    before the sets are intersected. Rarest first, a signature that a third of
    all documents have is a meeting point only of sets that have hardly another.
    A null text counts as empty; texts without words share the empty set.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), whole_text(text).alias("_text"))
    rows = with_signatures(rows, "_text", "sigs").drop("_text")
    rows = settled(spark, rows.withColumn("fingerprint", digest(F.col("sigs"))), "spot-rows")
    sets = rows.where(F.size("sigs") > 0).groupBy("fingerprint").agg(F.first("sigs").alias("sigs"))
    sets = settled(spark, sets.withColumn("n", F.size("sigs")), "spot-sets")
    each = sets.select("fingerprint", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = each.join(often, "sig").withColumn(
        "rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy("often", "sig"))
    )
    enough = F.ceil(F.col("n") * similarity - 1e-9)
    prefix = ranked.where((F.col("rank") <= F.col("n") - enough + 1) & (F.col("often") > 1))
    own = length_class(F.col("n"), similarity)
    prefix = settled(spark, prefix.withColumn("part", own), "spot-prefixes")
    left = prefix.select(
        F.col("fingerprint").alias("a"),
        F.col("n").alias("a_n"),
        F.col("rank").alias("a_rank"),
        "sig",
        F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"),
    )
    right = prefix.select(
        F.col("fingerprint").alias("b"), F.col("n").alias("b_n"), F.col("rank").alias("b_rank"), "sig", "part"
    )
    in_order = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    needed = F.ceil((F.col("a_n") + F.col("b_n")) * similarity / (1 + similarity) - 1e-9)
    rest = F.least(F.col("a_n") - F.col("a_rank"), F.col("b_n") - F.col("b_rank")) + 1
    candidates = (
        left.join(right, ["part", "sig"])
        .where(in_order & (F.col("a_n") >= F.col("b_n") * similarity - 1e-9))
        # From the first signature they share, enough must be left to share.
        .groupBy("a", "b")
        .agg(F.max(rest >= needed).alias("possible"))
        .where("possible")
    )
    of = lambda side: sets.select(F.col("fingerprint").alias(side), F.col("sigs").alias(f"{side}_sigs"))
    likeness = jaccard(F.col("a_sigs"), F.col("b_sigs"), similarity)
    pairs = (
        candidates.join(of("a"), "a")
        .join(of("b"), "b")
        .withColumn("similarity", likeness)
        .where(F.col("similarity") >= similarity)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    )
    return rows.select(key, "fingerprint"), pairs
