"""Mixing sources to target weights by whole and fractional repetitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import whole_text
from logtide.sources.storage import settled

#: Times a source may be repeated at most.
MAX_EPOCHS = 3
#: Weights by a source's place in the order of sources, repeating.
WEIGHTS = (1, 2, 3)
#: Hex digits of the sampling key by which sizes are summed, one after the other,
#: before the rows of one bucket are ranked.
BUCKET_DIGITS = (3, 6)

# Sums of words times weights may pass 64 bits.
_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sampling_key(seed: int, key: str, text: str) -> Column:
    """A place in a random order that reruns, retries and other plans agree on.

    Rows without a key are told apart by their text.
    """
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("-"), F.md5(whole_text(text))))
    return F.md5(F.concat(name, F.lit(f"/{seed}")))


def _wide(value: Column | int) -> Column:
    return (F.lit(str(value)) if isinstance(value, int) else value).cast(_WIDE)


def water_level(sources: DataFrame, epochs: int) -> tuple[int, Fraction]:
    """All words, and the words each unit of weight gets.

    A source above its cap is clamped to it, and what it leaves goes to the
    others by weight. That raises the level, so more may reach their caps; a
    round is one aggregation over the table of sources and needs only sums.
    """
    capacity = _wide(F.col("source_size")) * _wide(epochs)
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0, Fraction(0)
    level = Fraction(int(total), int(weight))
    while True:
        above = capacity * _wide(level.denominator) < _wide(F.col("weight")) * _wide(level.numerator)
        clamped, open_weight = sources.agg(
            F.sum(F.when(above, F.col("source_size") * epochs)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        risen = Fraction(int(total) - int(clamped or 0), int(open_weight))
        if risen == level:
            return int(total), level
        level = risen


def _in_buckets(rows: DataFrame, buckets: DataFrame, digits: int) -> DataFrame:
    """The rows whose place begins as the bucket of their source."""
    buckets = buckets.select(F.col("source").alias("of"), "bucket", "before", "rest")
    same = F.substring("place", 1, digits) == F.col("bucket")
    return rows.join(buckets, same & F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _cut_buckets(rows: DataFrame, outer: DataFrame, digits: int, unit: int) -> DataFrame:
    """``(source, rest, bucket, before)``: where the words of the places pass what is needed.

    Places are summed by their first digits inside the ``outer`` bucket of their
    source; a source has 16 buckets for each digit more, so few rows meet.
    """
    outer_digits = BUCKET_DIGITS[BUCKET_DIGITS.index(digits) - 1] if digits != BUCKET_DIGITS[0] else 0
    bucket = F.substring("place", 1, digits)
    if outer_digits:
        rows = _in_buckets(rows, outer, outer_digits).drop("bucket", "before", "rest")
    sums = rows.groupBy("source", bucket.alias("inner")).agg(F.sum("size").alias("words"))
    sums = sums.withColumnRenamed("source", "of")
    so_far = Window.partitionBy("source").orderBy("inner")
    ranked = sums.join(outer, F.col("of").eqNullSafe(F.col("source"))).withColumn(
        "reach", F.col("before") + F.sum("words").over(so_far)
    )
    start = F.col("reach") - F.col("words")
    return ranked.where(
        (_wide(F.col("reach")) * _wide(unit) > F.col("rest")) & (_wide(start) * _wide(unit) <= F.col("rest"))
    ).select("source", "rest", F.col("inner").alias("bucket"), start.alias("before"))


def plan_mix(
    docs: DataFrame,
    seed: int,
    epochs: int = MAX_EPOCHS,
    weights: tuple[int, ...] = WEIGHTS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of the documents, and per source what the mix takes of it.

    The rows are ``(key, source, size, place)``; the plan is ``(source,
    source_size, weight, target, whole, cut)``: every document is taken
    ``whole`` times, and once more if its ``place`` is not above ``cut``. Cuts
    are where the words before come nearest to the fraction a source still
    needs, so its taken words differ from the target by half a document at
    most.

    A null text has no words and a null source is a source of its own, last in
    order. Rows of equal key share a place and are taken alike. A table without
    rows or words has targets of 0. No text is moved: sums by source and bucket
    of places are combined before the shuffle, and only rows of the bucket a cut
    falls into are ranked.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key),
        F.col(source).alias("source"),
        word_count(whole_text(text)).alias("size"),
        sampling_key(seed, key, text).alias("place"),
    )
    rows = settled(spark, rows, "mix-rows")
    # One row per source: a table the size of the mix's configuration.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("number") % len(weights)).cast("long"))
        .drop("number")
    )
    sources = settled(spark, sources, "mix-sources")
    _, level = water_level(sources, epochs)

    # Shares in units of 1 / denominator words, so that all sums are exact.
    unit = level.denominator
    share = _wide(F.col("weight")) * _wide(level.numerator)
    full = _wide(F.col("source_size")) * _wide(unit)
    capped = F.col("full") * _wide(epochs) <= F.col("share")
    targets = (
        sources.withColumn("share", share.cast(_WIDE))
        .withColumn("full", full.cast(_WIDE))
        .select(
            "source",
            "source_size",
            "weight",
            "share",
            "full",
            F.when(capped, (F.col("source_size") * epochs).cast("double"))
            .otherwise((F.col("weight") * level.numerator).cast("double") / float(unit))
            .alias("target"),
            F.when(capped, epochs)
            .when(F.col("full") == 0, 0)
            .otherwise(F.expr("share div full"))
            .cast("long")
            .alias("whole"),
        )
        .withColumn(
            "rest",
            F.when(F.col("whole") >= epochs, _wide(0)).otherwise(
                F.col("share") - _wide(F.col("whole")) * F.col("full")
            ),
        )
    )

    cut_buckets = targets.select(
        "source", "rest", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before")
    )
    for digits in BUCKET_DIGITS:
        cut_buckets = settled(spark, _cut_buckets(rows, cut_buckets, digits, unit), "mix-buckets")
    near = (
        _in_buckets(rows, cut_buckets, BUCKET_DIGITS[-1])
        .groupBy("source", "place", "before", "rest")
        .agg(F.sum("size").alias("words"))
    )
    up_to = Window.partitionBy("source").orderBy("place")
    middle = (F.col("before") + F.sum("words").over(up_to)) * 2 - F.col("words")
    ranked = near.withColumn("middle", middle)
    inside = ranked.where(_wide(F.col("middle")) * _wide(unit) <= _wide(F.col("rest")) * 2)
    cuts = cut_buckets.select("source", F.col("bucket").alias("cut")).union(
        inside.select("source", F.col("place").alias("cut"))
    )
    cuts = cuts.groupBy("source").agg(F.max("cut").alias("cut"))
    plan = (
        targets.alias("t")
        .join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .select(
            "t.source",
            "source_size",
            "weight",
            "target",
            "whole",
            # A source whose share is whole takes no fraction.
            F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(""))).otherwise("").alias("cut"),
        )
    )
    return rows, settled(spark, plan, "mix-plan")


def copies(place: Column) -> Column:
    """How often a row is taken, beside the columns of its source's plan."""
    return F.col("whole") + (place <= F.col("cut")).cast("long")


def mix_counts(
    docs: DataFrame,
    seed: int,
    epochs: int = MAX_EPOCHS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)`` of every document.

    See ``plan_mix`` for nulls, ties and empty tables.
    """
    rows, plan = plan_mix(docs, seed, epochs, key=key, text=text, source=source)
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select(
        F.col(f"r.{key}"),
        "size",
        "source_size",
        "target",
        copies(F.col("place")).alias("copies"),
        (F.col("size") * copies(F.col("place"))).alias("taken"),
    )


def mixed(
    docs: DataFrame,
    seed: int,
    epochs: int = MAX_EPOCHS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in its own columns.

    Whether a row is taken follows from its place and the plan of its source,
    so texts meet only the table of sources, and none is shuffled for it.
    """
    _, plan = plan_mix(docs, seed, epochs, key=key, text=text, source=source)
    plan = plan.select(F.col("source").alias("_mix_source"), "whole", "cut")
    plan = plan.select("_mix_source", F.struct("whole", "cut").alias("_mix"))
    place = sampling_key(seed, key, text)
    number = F.col("_mix.whole") + (place <= F.col("_mix.cut")).cast("long")
    joined = docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_source")))
    repeated = joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), number.cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])
