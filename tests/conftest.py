import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


# Made at import: test modules build column expressions at module level.
SESSION = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
           .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
           .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over one text value `t`."""
    def run(value, *columns):
        row = spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run


@pytest.fixture
def each(spark):
    """Evaluate one column expression over many text values, in order."""
    def run(values, column):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", column.alias("c")).collect()
        return [r.c for r in sorted(rows)]

    return run
