import os
import shutil
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from keystrata.sources.shared import shared_dir

    shutil.rmtree(f"{shared_dir(session)}/{session.sparkContext.applicationId}", ignore_errors=True)
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """DuckDB over the smallest tables."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return folder, con
