"""Every registered query against its DuckDB statement (the driver's correctness gate)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import check, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    r = check(spark, con, name, SF_SMALL)
    assert r["status"] in ("ok", "no-oracle"), r


def test_entry_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["cnt", "event_type"] and out.count() > 0
