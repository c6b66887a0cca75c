import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tesserae.session import get_spark

    session = get_spark("tests", cpus=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows as sorted tuples of strings, columns by name, floats to six digits; a null is no string."""
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple("<null>" if v is None or (not isinstance(v, (str, list)) and pd.isna(v) is True) else (f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)) for v in row))
    return sorted(out)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL on the smallest tables."""

    def check(query, sql):
        got = query(spark, SF).toPandas()
        expected = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)

    return check
