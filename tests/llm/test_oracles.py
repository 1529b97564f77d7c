"""SQL of the contracts' queries against the queries, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from docquarry.llm import mixing, queries

SF = "/root/testdata/sf0.001"


#: The mix's contract columns; blocks, shards and positions beside them follow from random draws, which SQL can't express.
MIX = {"op3_mixing": mixing.oracle()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES | MIX))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = ["doc_id", "size", "source_size", "target", "taken"] if name in MIX else sorted(df.columns)
    names = ", ".join(cols)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, con.sql(f"select {names} from ({(queries.ORACLES | MIX)[name]})").fetchall()))
