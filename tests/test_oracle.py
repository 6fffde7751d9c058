"""Every registered query that has SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows_of(columns: list[str], rows: list) -> list:
    """The rows with their columns by name, sorted; whole numbers and truth values of any type are one."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: int(x) if isinstance(x, bool) or (isinstance(x, float) and x.is_integer()) else x
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = db.execute(entry.oracle_sql()[name])
    names, want = [d[0] for d in found.description], found.fetchall()
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want) and want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
