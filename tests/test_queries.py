import pytest
from compare import duck, same, type_names

from sparkloom.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    same(df, con, registry.ORACLES[name])
    assert type_names(df, con, registry.ORACLES[name]) == []
