"""Session helpers shared by the entry point, the bench and the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", app: str = "lumenfold") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_ready(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a master that runs in this one
    process, ``local`` or ``local[n]``, may fall back to a temporary folder: elsewhere
    that would not be shared, and a job without a shared folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (sc.master == "local" or sc.master.startswith("local[")):
        folder = tempfile.mkdtemp(prefix="lumenfold-checkpoint-")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder because it is read repeatedly.

    Row numbers and other values that depend on the order of rows are fixed by it.
    """
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()
