from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def value(x):
    """Values of Spark and DuckDB made comparable."""
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def same_rows(df, sql: str, sf_dir: str) -> None:
    """Asserts that a DataFrame and SQL over the same tables give the same rows, in whatever order."""
    from collections import Counter

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = Counter(tuple(value(dict(zip(columns, row, strict=True))[c]) for c in order) for row in found.fetchall())
    got = Counter(tuple(value(row[c]) for c in order) for row in df.collect())
    assert got == want
