"""Catalog queries against their SQL twins on the smallest tables.

The driver compares all of them; here a quick share runs by default, and all of them with
LOOMTRACE_ALL=1.
"""

import os

import pytest

import __spark_entry__ as spark_entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ("orientation_project net_unify affine_rects flatten_metals merged_metal_index "
         "connect_edges lvs_end_to_end json_shapes net_log via_records").split()
NAMES = sorted(spark_entry.CATALOG) if os.environ.get("LOOMTRACE_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, got, want, _, _, _ = compare(spark, SF, name, spark_entry.queries()[name], spark_entry.oracle_sql()[name], con)
    assert ok, f"{got} rows from Spark, {want} from SQL, or other values"


def test_every_query_has_a_twin():
    assert set(spark_entry.CATALOG) == set(spark_entry.ORACLES)


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["comp_id", "n_metals", "net", "is_consistent"]
    assert df.count() == 33
