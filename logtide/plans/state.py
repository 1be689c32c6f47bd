"""Small tables in numbered versions, and the state of a refresh.

A version is written whole and counts once it is complete, so a run that ends
early leaves the version before it in force.

The state has one row per site and day, and is a log: a version holds the rows
that changed, and the newest row of a day counts. Now and then all rows are
written together, under the number of the last change they contain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logtide.schema import DAY_KEYS, STATE_SCHEMA
from logtide.sources.storage import complete_versions, drop_partitions, settled

STATE = "sync_state"
#: Versions of changes after which all rows are written together.
MERGE_AFTER = 16


def read_version(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The version in force; without one, a table without rows."""
    versions = complete_versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(versions[max(versions)])


def write_version(spark: SparkSession, folder: str, rows: DataFrame, schema: StructType) -> None:
    """Put a new version in force. The one before stays until the next is complete.

    ``rows`` may be made from the version in force.
    """
    older = complete_versions(spark, folder)
    number = max(older, default=0) + 1
    rows = settled(spark, rows.select(*[f.name for f in schema.fields]), "version")
    # A number left by a run that ended early is overwritten.
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/version={number}")
    drop_partitions(spark, [version for n, version in older.items() if n < number - 1])


def _state_versions(spark: SparkSession, root: str) -> tuple[dict[int, str], dict[int, str]]:
    """Folders of the states written together, and of the changes, by number."""
    folder = f"{root}/{STATE}"
    return complete_versions(spark, f"{folder}/whole"), complete_versions(spark, folder)


def state_version(spark: SparkSession, root: str) -> int:
    """The version in force; 0 before the first refresh."""
    whole, changes = _state_versions(spark, root)
    return max([*whole, *changes], default=0)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The state in force: the newest row of each site and day."""
    whole, changes = _state_versions(spark, root)
    base = max(whole, default=0)
    folders = [whole[n] for n in whole if n == base] + [changes[n] for n in changes if n > base]
    if not folders:
        return spark.createDataFrame([], STATE_SCHEMA)
    names = [f.name for f in STATE_SCHEMA.fields]
    others = [n for n in names if n not in DAY_KEYS]
    version = F.regexp_extract("_metadata.file_path", ".*/version=([0-9]+)/", 1).cast("long")
    return (
        spark.read.schema(STATE_SCHEMA)
        .parquet(*folders)
        .select(*names, version.alias("version"))
        .groupBy(*DAY_KEYS)
        .agg(F.max_by(F.struct(*others), "version").alias("row"))
        .select(*[n if n in DAY_KEYS else f"row.{n}" for n in names])
    )


def write_changes(spark: SparkSession, root: str, changes: DataFrame) -> None:
    """Put changed or new rows of the state in force, one for a site and day.

    ``changes`` may be made from the state: what is read stays until the next
    but one time that all rows are written together.
    """
    folder = f"{root}/{STATE}"
    names = [f.name for f in STATE_SCHEMA.fields]
    number = state_version(spark, root) + 1
    # A number left by a run that ended early is overwritten.
    rows = changes.select(*names).hint("rebalance")
    rows.write.mode("overwrite").parquet(f"{folder}/version={number}")
    whole, written = _state_versions(spark, root)
    base = max(whole, default=0)
    if sum(n > base for n in written) < MERGE_AFTER:
        return
    together = read_state(spark, root).hint("rebalance")
    together.write.mode("overwrite").parquet(f"{folder}/whole/version={number}")
    old = [path for n, path in written.items() if n <= base]
    drop_partitions(spark, old + [path for n, path in whole.items() if n < base])
