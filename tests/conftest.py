import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bars import walk  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def walks():
    return pd.concat([walk(f"W{i:02d}", 320, i) for i in range(12)], ignore_index=True)


@pytest.fixture(scope="session")
def walk_bars(spark, walks):
    from tickloom.schema import BARS
    return spark.createDataFrame(walks, BARS).cache()


@pytest.fixture(scope="session")
def to_bars(spark):
    from tickloom.schema import BARS
    return lambda *frames: spark.createDataFrame(pd.concat(frames, ignore_index=True), BARS)
