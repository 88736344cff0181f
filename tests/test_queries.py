"""Every core query against its SQL, or at least running, on the smallest tables."""

import pytest
from conftest import DATA, same

from divrec.plans import problems, recombination

QUERIES = {**recombination.QUERIES, **problems.QUERIES}
ORACLES = {**recombination.ORACLES, **problems.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
