import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Workers import the package (and the helpers in the tests) from here.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")]
)

from mailbench.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "mailbench-tests",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate a column over one row of string columns."""

    def evaluate(column, **values):
        names = list(values) or ["_"]
        schema = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(values.get(n) for n in names)], schema)
        return df.select(column.alias("out")).first()["out"]

    return evaluate
