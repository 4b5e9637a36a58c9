"""Every named query against the same question in SQL, row for row."""

import __spark_entry__ as contract
import pytest

from sharedrift.plans.catalogue import QUERIES
from tests import compare

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    got_columns, got = compare.spark_rows(contract.queries()[name](spark, sf_dir))
    want_columns, want = compare.sql_rows(con, contract.oracle_sql()[name])
    assert got_columns == want_columns
    assert sum(got.values()) > 0
    missing, extra = want - got, got - want
    assert not missing and not extra, (
        f"{sum(got.values())} rows; {sum(missing.values())} missing, {sum(extra.values())} extra; "
        f"e.g. want {sorted(missing, key=str)[:2]} got {sorted(extra, key=str)[:2]}")


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
