"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _kind(dtype: str) -> str:
    kinds = {"varchar": "string", "integer": "int", "hugeint": "hugeint"}
    name = dtype.lower()
    return kinds.get(name, name)


def _sorted_rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    for column in frame.columns:
        frame[column] = frame[column].map(lambda v: v.date() if isinstance(v, pd.Timestamp) else v)
    return sorted(frame.itertuples(index=False, name=None), key=repr)


def mismatch(result: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> str | None:
    """What differs, or None."""
    expected = connection.sql(sql)
    spark_types = {f.name: f.dataType.simpleString() for f in result.schema.fields}
    sql_types = {n: _kind(str(t)) for n, t in zip(expected.columns, expected.types, strict=True)}
    if spark_types != sql_types:
        return f"schema {spark_types} <> {sql_types}"
    left, right = _sorted_rows(result.toPandas()), _sorted_rows(expected.df())
    if len(left) != len(right):
        return f"{len(left)} rows <> {len(right)}"
    for one, other in zip(left, right, strict=True):
        if one != other:
            return f"{one} <> {other}"
    return None
