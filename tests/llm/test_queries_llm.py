"""Every registered llm query on the smallest tables; against its SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from graphloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name in registry.oracle_sql():
        c = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        res = c.execute(registry.oracle_sql()[name])
        have = [x[0] for x in res.description]
        assert got == sorted(repr(tuple(r[have.index(x)] for x in cols)) for r in res.fetchall())
