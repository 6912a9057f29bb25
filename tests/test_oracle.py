"""Every registered query against its DuckDB oracle on the smallest driver data."""

import os

import pytest

from oracle_check import compare, duck_connect

from demandlens import plans

SMALL_SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL_SF), reason="driver data not present")


@pytest.fixture(scope="module")
def con():
    return duck_connect(SMALL_SF)


@pytest.mark.parametrize("name", sorted(plans.REGISTRY))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SMALL_SF, con)
    assert r["status"] in ("match", "no-oracle"), r


def test_entry_contract(spark):
    import importlib.util
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(__file__), "..",
                                                                       "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert mod.entry(spark).count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
