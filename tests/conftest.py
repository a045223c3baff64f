import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from salesgrid.session import build_session

    session = build_session(
        "local[8]",
        **{"spark_ui_enabled": "false", "spark_sql_shuffle_partitions": 4,
           "spark_driver_memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
