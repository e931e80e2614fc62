"""Every query with SQL equals DuckDB on the same tables."""

import math

import pytest

from crosspanel.plans.catalog import all_queries, all_sql

from .conftest import SF


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.6g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.6g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_oracle(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(all_sql()[name])
    assert sorted(want.columns) == columns
    rows = [tuple(plain(v) for v in row) for row in want.select(*(f'"{c}"' for c in columns)).fetchall()]
    got = [tuple(plain(v) for v in row) for row in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert len(got) == len(rows)
    key = lambda row: tuple(str(v) for v in row)
    wrong = [(a, b) for a, b in zip(sorted(got, key=key), sorted(rows, key=key), strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-5)) for x, y in zip(a, b, strict=True))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs_twice_alike(spark, duck, name):
    """Queries without SQL: rows, and the same ones each time."""
    a, b = (sorted(map(str, all_queries()[name](spark, SF).collect())) for _ in range(2))
    assert a == b
