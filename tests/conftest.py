import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quernlog.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def lines(spark):
    """Numbered lines of one source."""

    def make(texts, source="s"):
        return spark.createDataFrame(
            [(source, i + 1, t) for i, t in enumerate(texts)], "source_id string, line_no bigint, raw string"
        )

    return make


@pytest.fixture
def events(spark):
    """Event rows from (source, line, ts text or None, fields dict[, log_type, host])."""
    import json

    from pyspark.sql import functions as F

    def make(rows, log_type="web_access", host="h1"):
        data = [
            ("c1", r[0], r[1], r[2], "event", json.dumps(r[3]), json.dumps(r[3]), r[4] if len(r) > 4 else log_type,
             r[5] if len(r) > 5 else host)
            for r in rows
        ]
        df = spark.createDataFrame(
            data,
            "case_id string, source_id string, line_no bigint, t string, kind string, fields string, raw string, "
            "log_type string, host string",
        )
        return df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")

    return make
