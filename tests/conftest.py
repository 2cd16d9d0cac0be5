import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": str(top / "checkpoint")}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def cell(x):
    """A value as the oracle and Spark both have it."""
    import numpy as np
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(cell, x))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return float(x)
    return str(x)


def table(df):
    """Rows of a pandas frame in an order that does not depend on the engine, columns by name."""
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(cell, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con
