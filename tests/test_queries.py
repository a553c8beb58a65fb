"""Every registered query against its SQL on the smallest tables."""

import pytest

from motorpool.bindings import ORACLES, QUERIES
from tests.conftest import SMALL


def _cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


#: Tested against numpy and against all plans in test_builds.py.
NOT_IN_SQL = {"i15_fitted_demand", "i16_cheapest_moves"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == NOT_IN_SQL and not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert _canonical(df.columns, df.collect()) == _canonical(names, cursor.fetchall())
