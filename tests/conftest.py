import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import duck, session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(checkpoints=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)


@pytest.fixture(scope="session")
def tables(spark):
    from marshlight.plans.roles import Tables

    return Tables(spark, SMALL)
