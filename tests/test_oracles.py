"""Every registered query against its DuckDB SQL on the small driver tables."""

import pytest

from conftest import SF_SMALL
from relflow.plans.oracle import compare, duck
from relflow.queries import ORACLES, QUERIES

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(QUERIES[name](spark, SF_SMALL), _con(), ORACLES[name])
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r
    assert not r["type_mismatches"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
