"""Every registered query against its SQL, and rules that hold for all modules."""

import pathlib
import re

import pytest

from oracle import oracle_rows, spark_rows
from stallgrid import registry

ROOT = pathlib.Path(__file__).resolve().parent.parent / "stallgrid"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    got, names = spark_rows(registry.QUERIES[name](spark, sf))
    want, sql_names = oracle_rows(registry.ORACLE_SQL[name], sf)
    assert names == sql_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).columns


def test_rows_that_come_to_the_driver_are_bounded():
    """Every collect outside the corpus operators says what bounds it, and there are few."""
    found = 0
    for part in ("operators", "functions", "sources", "streaming", "plans"):
        for path in ROOT.glob(f"{part}/*.py"):
            for line in path.read_text().splitlines():
                if re.search(r"\.(collect|toPandas|toLocalIterator)\(\)", line):
                    found += 1
                    assert "# bounded: " in line, (path, line)
    assert found < 10


def test_no_cross_joins(spark, sf):
    for name in ("filtered_page", "facets_exclude_own", "related_attributes", "click_attribution", "trigram_fuzzy"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
