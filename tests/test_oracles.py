"""Every registered query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from atlaswright import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(df):
    columns = sorted(df.columns)

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return columns, sorted(repr([plain(v) for v in row]) for row in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert _rows(plans.QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_spatial_plan_has_no_nested_loop_over_boxes(spark):
    plan = plans.QUERIES["jn12_parents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "SortMergeJoin" in plan or "HashJoin" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node", "paths", "maps"]
    assert set(e.oracle_sql()) <= set(e.queries())
