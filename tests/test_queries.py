"""A sample of the registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_point  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = ["token_chunks", "separator_chunks_limited", "validated_relations", "edges", "edge_evidence",
          "community_overview", "supply_components", "nearest_vectors", "highlight_index", "added_text", "overall_progress"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value if value is None or isinstance(value, (bool, int)) else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, DATA)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
