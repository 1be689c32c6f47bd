"""Shards of nearly equal bytes that keep equal texts together.

Groups of equal texts, in the order of their first document, are atoms, and a
shard is a run of them. The smallest capacity for which the greedy cut needs no
more than the wanted shards is found by binary search; the cuts then keep to
that capacity and lie as evenly as the atoms let them.

Every question of the search is about a running total: the last group whose
total is not above some bound. The driver knows the totals at a bounded number
of places and what lies between them is asked for only where an answer depends
on it, so neither the groups nor their totals are ever gathered.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import (
    RANGE_ROWS,
    range_number,
    range_starts,
    running_totals,
    sort_key,
    whole_text,
)
from logtide.sources.storage import settled

#: Bytes a document takes besides its text.
ROW_BYTES = 16
#: Places at which running totals are known after each look at the table.
BLOCKS = 4096


@dataclass
class RunningTotals:
    """Running totals of the groups, as far as they are known.

    ``known`` holds totals that occur, ascending, 0 first. ``hidden[i]`` tells
    whether there are others between ``known[i]`` and the next.
    """

    table: DataFrame
    total: int
    blocks: int = BLOCKS
    known: list[int] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.known, self.hidden = [0, self.total], [True]
        self.look([(0, self.total)])

    def look(self, regions: list[tuple[int, int]]) -> None:
        """Learn totals between known ones, in disjoint regions: one look at the table.

        Each region is cut into equal blocks, more than it has gaps now, and
        every block tells its smallest and largest total and how many it has.
        What comes back is bounded by the number of blocks, and the filter
        reaches the row groups of the files.
        """
        total = F.col("total")
        lows, steps, firsts, first = [], [], [], 0
        for low, high in regions:
            gaps = bisect_left(self.known, high) - bisect_left(self.known, low)
            blocks = max(2 * gaps, self.blocks // len(regions))
            lows.append(low)
            steps.append(max(1, -(-(high - low) // blocks)))
            firsts.append(first)
            first += blocks + 1
        region = range_number(total, lows)
        of = lambda values: F.get(F.lit(values), region)
        block = of(firsts) + F.floor((total - of(lows)) / of(steps))
        inside = reduce(Column.__or__, [(total > low) & (total < high) for low, high in regions])
        found = (
            self.table.where(inside)
            .groupBy(block.alias("block"))
            .agg(F.min(total).alias("low"), F.max(total).alias("high"), F.count("*").alias("n"))
            .collect()
        )
        points = dict(zip(self.known, [*self.hidden, False], strict=True))
        for low, high in regions:
            for at in range(bisect_right(self.known, low), bisect_left(self.known, high)):
                del points[self.known[at]]
            points[low] = False
        for row in found:
            points[row["low"]] = row["n"] > 2
            points[row["high"]] = False
        self.known = sorted(points)
        self.hidden = [points[p] for p in self.known[:-1]]

    def floor(self, bound: int) -> tuple[int, int]:
        """Between which values the largest total not above ``bound`` lies."""
        at = bisect_right(self.known, bound) - 1
        low = self.known[at]
        if at == len(self.hidden) or not self.hidden[at]:
            return low, low
        return low, bound

    def ceil(self, bound: int) -> tuple[int, int]:
        """Between which values the smallest total not below ``bound`` lies."""
        at = bisect_left(self.known, bound)
        high = self.known[at]
        if high == bound or not self.hidden[at - 1]:
            return high, high
        return bound, high

    def undecided(self, least: list[int], most: list[int]) -> list[tuple[int, int]]:
        """Regions that hide where places between these bounds lie, disjoint and in order."""
        regions: list[tuple[int, int]] = []
        for low, high in sorted(zip(least, most, strict=True)):
            first = bisect_right(self.known, low) - 1
            last = min(bisect_right(self.known, high), len(self.hidden))
            gaps = [at for at in range(min(first, last - 1), last) if self.hidden[at]]
            if not gaps:
                continue
            start, end = self.known[gaps[0]], self.known[gaps[-1] + 1]
            if regions and start < regions[-1][1]:
                regions[-1] = (regions[-1][0], max(end, regions[-1][1]))
            else:
                regions.append((start, end))
        return regions


def greedy_cuts(totals: RunningTotals, shards: int, capacity: int) -> tuple[list[int], list[int]]:
    """Cuts that fill each shard as far as the capacity goes: at least, and at most."""
    least, most, low, high = [], [], 0, 0
    for _ in range(shards):
        low, high = totals.floor(low + capacity)[0], totals.floor(high + capacity)[1]
        least.append(low)
        most.append(high)
    return least, most


def smallest_capacity(totals: RunningTotals, shards: int, largest: int) -> int:
    """The smallest capacity with which the greedy cut needs ``shards`` shards at most."""
    low = max(largest, -(-totals.total // shards)) - 1  # too small, or may be
    high = low + 1 + largest  # always enough
    while True:
        # The largest capacity known to be too small, and the smallest known to do.
        fails, does = low, high
        while does - fails > 1:
            middle = (fails + does) // 2
            if greedy_cuts(totals, shards, middle)[0][-1] == totals.total:
                does = middle
            else:
                fails = middle
        high = does
        fails, does = low, high
        while does - fails > 1:
            middle = (fails + does) // 2
            if greedy_cuts(totals, shards, middle)[1][-1] < totals.total:
                fails = middle
            else:
                does = middle
        low = fails
        if high - low == 1:
            return high
        least, most = greedy_cuts(totals, shards, low + 1)[0], greedy_cuts(totals, shards, high)[1]
        totals.look(totals.undecided(least, most))


def _reverse_cuts(totals: RunningTotals, shards: int, capacity: int) -> tuple[list[int], list[int]]:
    """The earliest each cut may be if the shards after it are to hold the rest."""
    least, most, low, high = [totals.total], [totals.total], totals.total, totals.total
    for _ in range(shards - 1):
        low, high = totals.ceil(max(0, low - capacity))[0], totals.ceil(max(0, high - capacity))[1]
        least.append(low)
        most.append(high)
    return least[::-1], most[::-1]


def _resolved(
    totals: RunningTotals,
    cuts: Callable[[RunningTotals, int, int], tuple[list[int], list[int]]],
    shards: int,
    capacity: int,
) -> list[int]:
    """Cuts whose place is certain; looks at the table until it is."""
    while True:
        least, most = cuts(totals, shards, capacity)
        if least == most:
            return least
        totals.look(totals.undecided(least, most))


def _share(left: int, shards: int, sizes: list[int]) -> float:
    """An equal share of what is left, when groups above it (sizes descending) have shards of their own."""
    for size in sizes:
        if shards == 1 or size * shards <= left:
            break
        left, shards = left - size, shards - 1
    return left / shards


def even_cuts(
    totals: RunningTotals, shards: int, capacity: int, large: list[tuple[int, int]] | None = None
) -> list[int]:
    """Ends of the shards: none above the capacity, and each near an equal share of the rest.

    ``large`` has ``(size, running total)`` of the largest groups, as many as
    there are shards, descending. A shard takes a group at least while there are
    any, so none before the last group's is empty. Looks at the table until the
    places next to every ideal one are known.
    """
    latest = _resolved(totals, greedy_cuts, shards, capacity)
    earliest = _resolved(totals, _reverse_cuts, shards, capacity)
    while True:
        cuts, at, least, most = [], 0, [], []

        def around(place: int, least: list[int] = least, most: list[int] = most) -> tuple[int, int]:
            # The totals not above the place and above it, as far as they are known.
            above = min(place + 1, totals.total)
            under, over = totals.floor(place), totals.ceil(above)
            if under[0] != under[1] or over[0] != over[1]:
                least.append(place)
                most.append(above)
            return under[0], over[1]

        for number in range(shards):
            if at < totals.total:
                low = max(around(at)[1], earliest[number])
                high = min(latest[number], max(low, around(min(at + capacity, totals.total))[0]))
                sizes = [size for size, end in large or [] if end > at]
                share = _share(totals.total - at, shards - number, sizes)
                # Up to the next group above the share, whole shards of one size.
                run = min([end - size - at for size, end in large or [] if end > at and size > share], default=0)
                ideal = at + (run / max(1, round(run / share)) if run > 0 else share)
                near = [low, high, *around(int(ideal))]
                near = [p for p in near if low <= p <= high] or [high]
                at = min(near, key=lambda p: (abs(p - ideal), p))
            cuts.append(at)
        if not least:
            return cuts
        totals.look(totals.undecided(least, most))


def shard_documents(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    range_rows: int = RANGE_ROWS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    The law is ``bytes``: sizes of shards are as near to equal as whole groups of
    equal texts let them be, and the largest shard is as small as runs of groups
    can make it. ``slot`` counts the rows of a shard in ascending key order.
    ``grown_shard`` is null, as adding a shard moves other rows too.

    A null text is the empty text and both are one group; null keys come first;
    rows of equal key and text are told apart by their slots alone. A group
    larger than a share is a shard of its own and may leave later shards empty.
    An empty table has no shards.

    Texts are read once, for their digest; what is shuffled is a narrow row per
    document. A group that holds a third of all rows is summed before it is
    shuffled, and its rows are numbered by ranges of their keys.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key),
        sort_key(key).alias("place"),
        (F.octet_length(whole_text(text)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole_text(text).cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(whole_text(text), 256)).alias("digest"),
    )
    rows = settled(spark, rows, "shard-rows")
    starts = range_starts(rows, "place", range_rows)
    if not starts:
        return _result(rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0)), key)

    groups = rows.groupBy("digest").agg(
        F.min("place").alias("first"), F.min("size").alias("text_size"), F.sum("size").alias("group_size")
    )
    groups = settled(spark, groups, "shard-sums")
    groups = running_totals(
        groups, range_number(F.col("first"), starts), ["first", "text_size", "digest"], {"group_size": "total"}
    )
    groups = settled(spark, groups.sortWithinPartitions("total"), "shard-groups")
    table = groups.select("total")
    size = groups.agg(F.max("total").alias("total"), F.max("group_size").alias("largest")).first()
    totals = RunningTotals(table, size["total"], blocks)
    capacity = smallest_capacity(totals, shards, size["largest"])
    largest = groups.orderBy(F.desc("group_size"), "total").select("group_size", "total").limit(shards)
    cuts = even_cuts(totals, shards, capacity, [tuple(row) for row in largest.collect()])

    # A group belongs to the first shard that ends at its running total or behind it.
    bounds = F.lit(cuts[:-1] or [size["total"]])
    shard = F.size(F.filter(bounds, lambda end: end < F.col("total"))).cast("int")
    placed = rows.join(groups.select("digest", shard.alias("shard")), "digest")
    placed = settled(spark, placed.withColumn("_range", range_number(F.col("place"), starts)), "shards")
    # Rows of a shard in a range of keys, and those in the ranges before.
    counts = placed.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("shard", "_range").orderBy("place", "text_crc32", "digest")
    numbered = (
        placed.withColumn("slot", F.row_number().over(inside))
        .join(offsets, ["shard", "_range"])
        .withColumn("slot", F.col("slot") + F.col("skip") - 1)
    )
    return _result(numbered, key)


def _result(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        F.col(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
