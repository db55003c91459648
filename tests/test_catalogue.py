"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import duckdb
import pytest

from sievewright.plans import catalogue, derived, evidence, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and not isinstance(v, str) else v
    return sorted(([cell(v) for v in r] for r in pdf.astype(object).values.tolist()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, tiny, name):
    got = registry.QUERIES[name](spark, tiny).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # timestamps as text
        if "datetime" in str(got[c].dtype):
            got[c], want[c] = got[c].astype(str), want[c].astype(str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(map(close, a, b)), [(x, y) for x, y in zip(a, b, strict=True) if not close(x, y)][:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0
