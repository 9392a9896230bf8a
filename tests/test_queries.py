"""Each query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from rimfold.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())
    rel = duck.sql(catalog.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_golden_score(spark):
    """The known score of the derived tables: 150 images, 2972 matches."""
    r = catalog.QUERIES["ag2_dataset_score"](spark, str(DATA)).first()
    assert (r["images"], r["matches"]) == (150, 2972) and r["dataset_score"] == pytest.approx(78.114509671445, abs=1e-6)
