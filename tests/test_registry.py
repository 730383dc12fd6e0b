import pytest

from engramite.plans import registry
from tests.oracle import compared, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name not in registry.SQL:
        assert df.columns and df.count() >= 0
        return
    got, want = compared(df, con, registry.SQL[name])
    assert got == want
    assert got or name == "reasoning_chains", "no rows to compare"
