import tempfile

import pytest
from pyspark.sql import SparkSession

from concordat.session import SESSION_CONF


def make_session(cores: int = 8) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="concordat-tests-")))
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
