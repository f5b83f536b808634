import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from orderlens import model_from_star  # noqa: E402
from orderlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "orderlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return model_from_star(spark, SF)


@pytest.fixture(scope="session")
def star_small(spark):
    return model_from_star(spark, "/root/testdata/sf0.001")
