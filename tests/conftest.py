import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomline.session import session

    more = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    s = session("local[4]", 4, **more)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
