import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def values(rows):
    def one(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


CORE = [n for n in entry.queries() if n.startswith("q") or n.startswith("p3_")]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["full_hash", "size", "file_count", "reclaimable_bytes"]


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert values(got.select(*columns).collect()) == values(want.project(quoted).fetchall())


def test_scratch_is_deleted(spark, tmp_path):
    from dupscape.session import clear_scratch, materialize, shared_dir

    df = materialize(spark.range(3), "x")
    assert df.count() == 3
    clear_scratch(spark)
    root = shared_dir(spark).removeprefix("file://")
    assert not glob.glob(f"{root}/dupscape/{spark.sparkContext.applicationId}/*")
