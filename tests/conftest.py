import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from timberline.session import SESSION_CONF, prepare

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


LINES = "dataset string, dialect string, source_id string, source_line long, id long, line string"


@pytest.fixture(scope="session")
def to_lines(spark):
    def make(texts, dialect="generic", dataset=None):
        name = dataset or dialect
        rows = [(name, dialect, name, n, n, text) for n, text in enumerate(texts, start=1)]
        return spark.createDataFrame(rows, LINES)

    return make
