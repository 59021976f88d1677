import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relaysync.session import get_spark, shared_root  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="relaysync-tests", shuffle_partitions=4,
                  extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="relaysync-wh-")})
    shared_root(s)  # uses spark.checkpoint.dir when set, else a folder of our own
    yield s
