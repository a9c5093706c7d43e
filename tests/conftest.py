from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillon.runtime import session

    s = session("quillon-tests", cpus="4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def same_as_oracle(spark, duck, data, query, sql):
    df = query(spark, data)
    columns = sorted(df.columns)
    got = sorted(plain(tuple(r)) for r in df.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(plain, duck.execute(f"SELECT {names} FROM ({sql}) q").fetchall()))
    assert got == want
