"""Every registered query against its SQL oracle, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

# The training-data queries have tests of their own
QUERIES = {k: v for k, v in entry_module.queries().items() if k not in entry_module.TEXT_QUERIES}
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k not in entry_module.TEXT_ORACLES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    yield connection
    connection.close()


def canonical(columns, rows):
    """Rows with columns in name order, in a fixed order; values must be equal exactly."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(row[i] for i in order) for row in map(_sortable, rows))


def _sortable(row):
    return [(value is None, "" if value is None else value) for value in row]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    assert canonical(found.columns, rows) == canonical(expected.columns, expected.fetchall())


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == [
        "business_line", "target_srs_ready", "total_count", "srs_ready_count", "adherence_pct",
        "meets_target",
    ]
    rows = result.collect()
    assert len(rows) == 15
    assert sum(r["meets_target"] for r in rows) == 5
