import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from bench import session

    spark = session(4)
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def simulated(tmp_path_factory):
    from simulation import simulate

    return simulate(tmp_path_factory.mktemp("sim"))
