"""Session defaults and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs more than building the long parsing plan itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "timberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators expect; keyword conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on (naive times are UTC).

    The JVM does not compile methods above 8000 bytes of bytecode; with the
    lower limit the long parsing projections are generated per operator, in
    pieces it does compile.
    """
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}
    for key, value in wanted.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def workspace(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests) a temporary folder stands in; on a cluster a
    machine-local folder would lose data with its machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.timberline.workspace", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="timberline-")
    spark.conf.set("spark.timberline.workspace", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder for one table, below the application's own (and the current scratch) folder."""
    scratch = spark.conf.get("spark.timberline.scratch", "")
    return f"{_own_folder(spark)}/{scratch}{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{workspace(spark)}/timberline/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete all tables this application wrote on the way; results read from them are gone with them."""
    _delete(spark, _own_folder(spark))


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are deleted at its end: for micro-batches and other repeated work."""
    before = spark.conf.get("spark.timberline.scratch", "")
    name = f"{before}scratch-{uuid.uuid4().hex}/"
    spark.conf.set("spark.timberline.scratch", name)
    try:
        yield
    finally:
        spark.conf.set("spark.timberline.scratch", before)
        _delete(spark, f"{_own_folder(spark)}/{name}")


def cut(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` once, to a new folder or to ``path``, and go on from the written table.

    Cuts lineage, survives lost executors, and gives the planner real byte
    counts: later joins broadcast such a table only when its files are below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffle otherwise.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
