"""Every registered query of the library proper: its SQL, run by DuckDB, gives the same rows and column names."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from docquarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v: object) -> str:
    if v is None:
        return "-"
    if isinstance(v, list | np.ndarray):
        return str([plain(x) for x in v])
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        names = ", ".join(f'"{c}"' for c in cols)
        want = sorted(tuple(map(plain, r)) for r in duck.sql(f"select {names} from ({sql})").fetchall())
        assert got == want
    else:
        assert got
