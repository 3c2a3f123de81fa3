"""Every query runs on the smallest tables, and those with SQL agree with it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from procuris.plans import features, matching, models, registry, served

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


@pytest.fixture(scope="module", autouse=True)
def one_matrix():
    """The vendor matrix is made once for all queries here."""
    made, first = {}, features.matrix
    with pytest.MonkeyPatch.context() as patch:
        for module in (features, matching, models, served):
            patch.setattr(module, "matrix", lambda spark, d: made.setdefault(d, None) or made.update({d: first(spark, d)}) or made[d])
        yield


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_and_sql_agree(spark, duck, name):
    rows = registry.QUERIES[name](spark, FOLDER)
    names = sorted(rows.columns)
    duck.execute(registry.SQL[name])
    heads = [d[0] for d in duck.description]
    assert sorted(heads) == names
    want = sorted("|".join(plain(r[heads.index(n)]) for n in names) for r in duck.fetchall())
    assert sorted("|".join(plain(r[n]) for n in names) for r in rows.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
