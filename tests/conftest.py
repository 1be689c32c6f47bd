from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from logtide.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("logtide-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = build_session(builder)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
