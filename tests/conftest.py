import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from jobledger.schema import REPORT_DDL  # noqa: E402
from jobledger.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark, tmp_path):
    """Hand-written reports as a DataFrame of the model's schema."""
    import json

    def build(*reports):
        path = tmp_path / f"reports-{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(json.dumps(r) for r in reports))
        return spark.read.schema(REPORT_DDL).json(str(path))

    return build
