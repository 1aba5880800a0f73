import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skirmish.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():  # a folder of its own only where none is named
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return tune(s)


@pytest.fixture(params=[False, True], ids=["plain", "split"])
def split(request, spark):
    """Both plans; small range partitions are kept apart so that the split plan really has blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if request.param else "true")
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
