"""Every query with SQL gives what DuckDB gives; all queries run."""

import os

import duckdb
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, sf, duck, tmp_path, name):
    got = registry.QUERIES[name](spark, sf)
    got.write.parquet(str(tmp_path / "got"))
    if name not in registry.ORACLE_SQL:
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS SELECT * FROM ({registry.ORACLE_SQL[name]})")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    names = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert names == sorted(got.columns)
    cols = ", ".join(names)
    for one, two in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {cols} FROM {one} EXCEPT ALL SELECT {cols} FROM {two}").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert {"query_id", "document_id", "score"} <= set(out.columns) and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
