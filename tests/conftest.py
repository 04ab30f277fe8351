import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    found = session("local[4]")
    found.conf.set("spark.sql.shuffle.partitions", "4")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
