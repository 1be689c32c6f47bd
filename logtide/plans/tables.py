"""Writing day- and period-partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key brought together, in tasks of similar size.

    The rebalance hint lets adaptive execution merge small keys into one task
    and cut a key with too many rows into several, so a site or day that holds
    most of the data becomes more files instead of one long task.
    """
    return rows.hint("rebalance", *[F.col(k) for k in keys])


def write_partitioned(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str | Column] = (),
    options: dict[str, str] | None = None,
) -> None:
    """Write a partitioned Parquet table, replacing just the partitions in ``rows``."""
    (
        balanced(rows, keys)
        .sortWithinPartitions(*keys, *order)
        .write.partitionBy(*keys)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(options or {"compression": "zstd"}))
        .parquet(path)
    )


def byte_setting(spark: SparkSession, key: str) -> int:
    """A size of the session in bytes."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def write_ordered(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    options: dict[str, str],
) -> None:
    """Add to a partitioned Parquet table files that are disjoint ranges of the order.

    Rows are dealt by ranges of the keys and the order, as many as ``size``
    (bytes) needs, so a partition of ordinary size is one file or two, and one
    of any size is several files that follow each other. Rows equal in all of
    the order stay together.
    """
    spark = rows.sparkSession
    advisory = byte_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    ranges = max(1, -(-size // advisory))
    dealt = rows.repartitionByRange(ranges, *keys, *order) if ranges > 1 else rows.coalesce(1)
    (
        dealt.sortWithinPartitions(*keys, *order)
        .write.partitionBy(*keys)
        .mode("append")
        .options(**options)
        .parquet(path)
    )
