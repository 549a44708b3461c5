"""Each of the engine's queries against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sparkveil.plans import fixtures as X
from sparkveil.plans import registry as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "documents", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    r = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in sorted(cols)) for x in rows) == want


def test_charmap_of_every_document(spark):
    whole = queries.QUERIES["charmap"](spark, SF).select("doc_id").distinct().count()
    assert whole == X.ja_docs(spark, SF).filter("length(text) > 0").count()
