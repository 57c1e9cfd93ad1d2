import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in (DATA / sf).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def small():
    return tables("sf0.001")


def plain(df):
    """Rows as sorted tuples of text, columns by name."""
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return cols, sorted(tuple(cell(r[c]) for c in cols) for r in df.astype(object).to_dict("records"))
