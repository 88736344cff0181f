"""Every query of the subpackage against its SQL, or at least running, on the smallest tables."""

import os

import pytest
from conftest import DATA, same

from divrec.llm.queries import ORACLES, QUERIES, TOKENIZER


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name == "p8_mix" and not os.path.exists(TOKENIZER):
        pytest.skip("no vocabulary file")
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        assert df.count() > 0
