"""Every registered query of the engine against its SQL, and the driver's contract."""

import pytest

import __spark_entry__
from conftest import same_rows
from stratalog.plans import queries as engine


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, sf_dir, name):
    df = engine.queries()[name](spark, sf_dir)
    sql = engine.oracle_sql().get(name)
    if sql:
        same_rows(df, sql, sf_dir)
    else:
        assert df.count() > 0


def test_counter_rate_of_repeated_times(spark, sf_dir, tmp_path):
    """Copies of events at the same times, with other values: by sequence, in whatever order rows are stored. The result is one that the SQL allows."""
    from itertools import pairwise

    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn("event_id", F.expr("event_id + copy * 1000333")).drop("copy")
    series = {}
    for r in copies.selectExpr("event_type", "unix_millis(CAST(ts AS TIMESTAMP)) AS ms", "event_id").collect():
        series.setdefault((r.event_type, r.ms // 86_400_000), []).append((r.ms, r.event_id))
    want = {}
    for key, s in series.items():
        s.sort()
        values = [i % 1000 for _, i in s]
        grown = sum(b - a if b >= a else b for a, b in pairwise(values))
        want[key] = round(grown * 1000 / (s[-1][0] - s[0][0]), 6) if s[-1][0] > s[0][0] else None
    for name, order in (("up", F.col("event_id")), ("down", F.col("event_id").desc()), ("mixed", F.xxhash64("event_id"))):
        copies.coalesce(1).sortWithinPartitions(order).write.parquet(str(tmp_path / name / "events.parquet"))
        got = engine.queries()["counter_rate"](spark, str(tmp_path / name)).collect()
        assert {(r.unit, r.bucket): None if r.rate is None else round(r.rate, 6) for r in got} == want


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert df.columns == ["timeline", "log_offset", "ts_ms", "payload"]


def test_entry_without_the_training_data_operators(tmp_path):
    """A copy without those folders still imports and has the engine's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "stratalog", tmp_path / "stratalog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
