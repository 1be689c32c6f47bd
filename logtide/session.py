"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates and hours of the log are UTC.
    "spark.sql.session.timeZone": "UTC",
    # Adaptive execution merges small shuffle partitions, splits skewed joins
    # and balances the table writes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Replace only the partitions a job writes.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with these settings; master, memory and storage are the caller's."""
    builder = builder or SparkSession.builder.appName("logtide")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
