import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from loomstat.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and read one back as sorted tuples."""

    class Rows:
        @staticmethod
        def of(data, schema):
            return spark.createDataFrame(data, schema)

        @staticmethod
        def sorted(df, *columns):
            picked = df.select(*columns) if columns else df
            return sorted((tuple(r) for r in picked.collect()), key=repr)

        @staticmethod
        def listed(df, *columns):
            picked = df.select(*columns) if columns else df
            return [tuple(r) for r in picked.collect()]

    return Rows
