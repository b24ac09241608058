import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sample_df(spark):
    return spark.createDataFrame(
        [
            (25.0, 50000.0, "HR", 88.0),
            (30.0, 75000.0, "IT", 92.0),
            (None, 60000.0, "IT", 76.0),
            (45.0, None, None, 85.0),
            (22.0, 45000.0, "Sales", None),
            (30.0, 75000.0, "IT", 92.0),
            (25.0, 50000.0, "HR", 88.0),
        ],
        "age double, salary double, dept string, score double",
    )


@pytest.fixture
def clean_df(spark):
    return spark.createDataFrame(
        [
            (25, 50000, "HR", 80),
            (30, 60000, "IT", 85),
            (35, 70000, "Sales", 90),
            (40, 80000, "Finance", 75),
            (45, 90000, "Ops", 88),
        ],
        "age bigint, salary bigint, dept string, score bigint",
    )


@pytest.fixture
def full_df(spark):
    return spark.createDataFrame(
        [
            (1.0, 10.0, "A", "2024-01-01"),
            (2.0, 20.0, "B", "2024-01-02"),
            (None, 30.0, "B", "2024-01-03"),
            (4.0, None, " ", None),
            (-5.0, 50.0, "NA", "2024-01-05"),
            (1000.0, 60.0, None, "2024-01-06"),
        ],
        "num1 double, num2 double, cat string, date_col string",
    )


@pytest.fixture
def trend_df(spark):
    from pyspark.sql import functions as F

    return spark.range(12).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("date"),
        F.col("id").alias("x"),
        (F.col("id") * 3 + 1).alias("y"),
        F.when(F.col("id") < 8, "A").otherwise("B").alias("cat"),
    )


def column(df, name):
    return [r[name] for r in df.select(f"`{name}`").collect()]
