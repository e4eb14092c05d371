"""One local session for all tests, and the comparison with SQL."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(value):
    if value is None or value is pd.NA or value != value or str(value) == "NaT":
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) else round(value, 6)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def rows_of(frame):
    """Rows in a form that doesn't depend on the engine, sorted."""
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(_plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))
