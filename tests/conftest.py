import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


def make_session(cores: str = "8") -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cores}]").appName("formline-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/formline-warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def tiny_groups(spark):
    """Every group of more than 40 rows counts as hot."""
    spark.conf.set("formline.groupRows", "40")
    spark.conf.set("formline.probeBytes", "0")
    yield
    spark.conf.unset("formline.groupRows")
    spark.conf.unset("formline.probeBytes")
