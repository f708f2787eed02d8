import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    """A session for tiny tables: two partitions, and no code to compile for each plan."""
    conf = {
        "spark.master": "local[2]", "spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "1m",
    }
    s = SparkSession.builder.config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
