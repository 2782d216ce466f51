"""Every registered query with SQL beside it, held against DuckDB on the same tables."""

import math

import pytest

from medialake.queries import all_queries, all_sql


def canon(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return f"{float(x) + 0.0:.6g}"
        return str(x)

    return sorted("|".join(one(row[k]) for k in sorted(row)) for row in rows)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = all_queries()[name](spark, sf)
    ours = [r.asDict() for r in df.collect()]
    cursor = duck.execute(all_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(ours) == canon(dict(zip(columns, r)) for r in cursor.fetchall())


def test_every_query_without_sql_runs(spark, sf):
    for name in sorted(set(all_queries()) - set(all_sql())):
        assert all_queries()[name](spark, sf).count() > 0, name


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
