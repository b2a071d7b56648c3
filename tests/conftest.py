import uuid

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    top = f"/tmp/loregraph-tests-{uuid.uuid4().hex[:10]}"
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", f"{top}/shared")
        .config("spark.sql.warehouse.dir", f"{top}/warehouse")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """The values of Column expressions over one row of strings."""

    def run(make, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(v,) for v in values], "x string")
        return [r[0] for r in df.select(make(F.col("x"))).collect()]

    return run
