"""Every query of the library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loamsift.plans.queries import ORACLES, QUERIES
from tests.conftest import SF

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_a", "doc_b", "similarity"]
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
