import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(data):
    """Whether rows of a DataFrame are those of SQL over the test tables, in another engine."""
    import duckdb

    from quillspark.sources.library import RAW

    con = duckdb.connect()
    for t in RAW:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")

    def plain(value):
        if isinstance(value, float):
            return round(value, 9)
        return str(value) if hasattr(value, "isoformat") else value

    def check(df, sql):
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in order]) for r in got.fetchall())
        assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == want

    return check
