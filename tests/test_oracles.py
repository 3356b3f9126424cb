"""Every registered query of the reference's operators against its DuckDB SQL."""

import math

import pytest

from framewright.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, sf, key):
    frame = QUERIES[key](spark, sf)
    names = sorted(frame.columns)
    ours = sorted(repr(tuple(map(plain, row))) for row in frame.select(*names).collect())
    if key not in ORACLES:
        assert ours
        return
    relation = duck.sql(ORACLES[key])
    assert sorted(relation.columns) == names
    theirs = sorted(repr(tuple(map(plain, row))) for row in relation.select(*[f'"{n}"' for n in names]).fetchall())
    assert ours == theirs
