import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def same_rows(df, expected) -> bool:
    """Rows of a Spark frame and of a pandas frame, in any order."""
    got = df.toPandas()
    cols = sorted(expected.columns)
    assert sorted(got.columns) == cols

    key = lambda r: tuple("" if v is None else v for v in r)
    a, b = sorted(map(tuple, form_safe(got[cols])), key=key), sorted(map(tuple, form_safe(expected[cols])), key=key)
    return a == b


def form_safe(d):
    d = d.astype(object)
    return [tuple(None if v is None or v != v else str(v) for v in row) for row in d.itertuples(index=False)]
