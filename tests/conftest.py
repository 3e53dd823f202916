import os
import tempfile

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import local_session

    session = local_session("tests", cores=4, shuffle_partitions=4, **{"spark.sql.execution.arrow.pyspark.enabled": "true"})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
