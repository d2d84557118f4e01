import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def genome(spark):
    """chr1 of 1000 bases (a multiple of the bin size 100) and chr2 of 555."""
    return spark.createDataFrame([("chr1", 1000, None, 0), ("chr2", 555, 500, 1)],
                                 "chrom string, length int, mappable long, ord int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
