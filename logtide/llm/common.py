"""What several of the text operators share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import logtide

#: Documents a range of keys should hold, and the most ranges a table is cut into.
RANGE_ROWS = 20_000
MOST_RANGES = 8192

_MIN_LONG = -(2**63)
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Python functions name the modules they come from, and executors need not
    have them. It is what ``--py-files`` does.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(logtide.__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="package-"))
    archive = folder / "logtide.zip"
    with zipfile.ZipFile(archive, "w") as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def whole_text(column: str = "text") -> Column:
    """The text of a row; a null is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def sort_key(column: str) -> Column:
    """An integer key in its ascending order, null as the smallest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(_MIN_LONG).cast("long"))


def range_starts(rows: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> list[int]:
    """First keys of ranges that hold about ``range_rows`` rows each, ascending.

    The keys are quantiles that occur in the column, the smallest one included,
    so no range is empty and each begins with a row of that very key. Only as
    many keys as there are ranges reach the driver (``MOST_RANGES`` at most).
    An empty table has none.
    """
    n = rows.count()
    if n == 0:
        return []
    parts = max(1, min(MOST_RANGES, -(-n // range_rows)))
    wanted = F.array(*[F.lit(i / parts) for i in range(parts)])
    found = rows.agg(
        F.percentile_approx(key, wanted, max(10_000, 20 * parts)).alias("starts"),
        F.min(key).alias("first"),
    ).first()
    return sorted({found["first"], *found["starts"]})


def range_number(key: Column, starts: list[int]) -> Column:
    """The range a key belongs to: a binary search in the literal starts."""
    steps, step = [], 1
    while step < len(starts):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    bounds = F.lit(starts[1:])
    last = len(starts) - 1
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, by: F.when(
            (at + by <= last) & (F.get(bounds, F.least(at + by, F.lit(last)) - 1) <= key), at + by
        ).otherwise(at),
    )


def running_totals(rows: DataFrame, ranges: Column, order: list, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running totals of columns over the whole order; ``sums`` names them.

    Sums of ranges come first, one row per range, and the total of the ranges
    before is added to the running total inside a range. ``ranges`` must be
    ascending in the order.
    """
    rows = rows.withColumn("_range", ranges)
    per_range = rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range, MOST_RANGES at most.
    return (
        rows.withColumns({to: F.sum(c).over(inside) for c, to in sums.items()})
        .join(F.broadcast(offsets), "_range")
        .withColumns({to: F.col(to) + F.col(f"_{c}") for c, to in sums.items()})
        .drop("_range", *[f"_{c}" for c in sums])
    )
