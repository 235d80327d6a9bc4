import os

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seqloom.session import local_session

    return local_session(4, "4g", 8, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
