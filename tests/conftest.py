from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pyspark.sql import functions as F  # noqa: E402

from streamgrid.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "streamgrid-tests",
        master="local[4]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def observe(spark):
    """Observations from (stream, seq, us, value[, arrival]) tuples, all in one session with t0 given."""

    def make(rows, t0=0, session="s"):
        full = [(session, r[0], r[1], r[2], r[4] if len(r) > 4 else r[2], float(r[3]), t0) for r in rows]
        schema = (
            "session_id string, stream_id string, seq bigint, us bigint, arrival_us bigint, value double, t0 bigint"
        )
        return spark.createDataFrame(full, schema).withColumn("ts", F.timestamp_micros("us"))

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
