import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Values of a Column function over texts, in their order."""

    def of(made, *columns):
        rows = [(i, *r) for i, r in enumerate(zip(*columns, strict=True))]
        names = ["i", *"abcdef"[: len(columns)]]
        df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names))
        return [r[1] for r in df.select("i", made(*names[1:]).alias("v")).orderBy("i").collect()]

    return of
