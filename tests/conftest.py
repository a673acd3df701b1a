import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers are started by the JVM with this environment: let them import
# the package and helper classes defined in test modules.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="quire-tests")
    yield s
    s.stop()


def one_col(spark, values, name="v", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")
