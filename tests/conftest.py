import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# Optional public sample files (the Iris and mall-customers CSVs); tests that
# need them are skipped unless these variables point at local copies.
IRIS = os.environ.get("TABTUNE_IRIS_CSV", "")
MALL = os.environ.get("TABTUNE_MALL_CSV", "")


@pytest.fixture(scope="session")
def spark():
    from tabtune.session import get_session
    s = get_session("local[4]", shuffle_partitions=8)
    yield s


def table(spark, name, sf=SF):
    from tabtune.sources.tables import read_table
    return read_table(spark, f"{sf}/{name}.parquet", "parquet")


def needs(path):
    return pytest.mark.skipif(not path or not os.path.exists(path), reason="sample file not set")
