import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from propcube.session import get_session
    s = get_session("local[4]", app_name="propcube-tests", extra={"spark.sql.shuffle.partitions": "4"})
    if not s.sparkContext.getCheckpointDir():  # tests own their checkpoint folder
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="propcube-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from propcube.sources.bridge import Tables
    return Tables(spark, SF_SMALL)
