"""Every query with an SQL twin agrees with DuckDB on the sf0.001 tables (the driver runs
the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

from robustq.plans import registry

registry.load_all()
ORACLE = dict(registry.ORACLE)
QUERIES = dict(registry.QUERIES)


# fits and searches to their end, models, and what SQL is too slow for: tested in test_training.py
# (the first steps of the fits and the search against SQL) and test_sources_streams.py
NO_SQL = {"label_projection", "linear_probe", "greedy_trigger_search", "score_model", "reorder_distinct"}


def test_every_query_has_an_entry():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert len(QUERIES) == 72
    assert set(QUERIES) - set(ORACLE) == NO_SQL


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, duckcon, key):
    ok, n, detail = compare(QUERIES[key](spark, SF_SMALL), duckcon, ORACLE[key])
    assert ok, f"{key}: {detail}"
    assert n > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_no", "method", "avg_acc"]
    assert df.count() == 14
