import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    from quizloom.sources.tables import ship_package

    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    return folder
