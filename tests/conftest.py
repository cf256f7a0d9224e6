import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalogq.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8)
    # Generated code that does not compile is an error here, not a slow path.
    session.conf.set("spark.sql.codegen.fallback", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
