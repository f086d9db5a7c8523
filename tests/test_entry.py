import __spark_entry__ as entry
import pytest

import workload

# queries that may have no rows on the smallest tables: no two descriptions need be alike there, and no count need differ
MAY_BE_EMPTY = {"count_mismatch", "description_pairs"}


@pytest.mark.parametrize("name", list(workload.queries()))
def test_every_query_runs_and_has_rows(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0 or name in MAY_BE_EMPTY


def test_every_query_of_the_workload_has_sql():
    assert set(workload.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "books", "mean_length"] and 0 < df.count() <= 8
