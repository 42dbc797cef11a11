import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL


def compare(spark, duck, run, sql, folder):
    """Rows of a query and of its SQL, columns by name, as sorted strings."""

    def canon(names, rows):
        order = sorted(range(len(names)), key=lambda i: names[i])

        def text(v):
            return "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)

        return sorted(names), sorted([text(r[i]) for i in order] for r in rows)

    df = run(spark, folder)
    got = duck.execute(sql)
    return canon(df.columns, [tuple(r) for r in df.collect()]), canon([d[0] for d in got.description], got.fetchall())


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c
