"""Every registered query with an oracle agrees with DuckDB on sf0.01 (rows, columns, values)."""

import pytest

from __spark_entry__ import entry
from evalspark.plans.oracle import ORACLE
from evalspark.plans.queries import QUERIES
from tools.oracle_check import compare, duck, type_mismatches

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    frame = QUERIES[name](spark, SF)
    got = frame.toPandas()
    want = con.execute(ORACLE[name]).df()
    assert compare(got, want) is None
    assert type_mismatches(frame.schema, con.sql(ORACLE[name])) == {}


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n > 0


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"topics", "k_sweep", "cluster_crosstab", "topic_crosstab"}
