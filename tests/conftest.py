import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ferret.session import get_spark
    shared = tmp_path_factory.mktemp("shared")
    s = get_spark("local[4]", shuffle_partitions=4, app="ferret-tests", conf={"spark.checkpoint.dir": f"file://{shared}"})
    yield s
    s.stop()
