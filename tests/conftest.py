import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from hourloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tables here are tiny: compiling plans would take longer than running them.
    settings = {
        "spark.driver.memory": "6g",
        "spark.sql.shuffle.partitions": "3",
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    }
    session = local_session(4, "tests", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
