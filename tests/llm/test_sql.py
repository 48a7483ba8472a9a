"""The queries that SQL expresses, against it."""

from pathlib import Path

import duckdb
import pytest

from loamsift.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()))) == sorted(map(str, want.fetchall()))
