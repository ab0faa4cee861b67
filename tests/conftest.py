import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from evidentia.session import session

    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "1m"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
