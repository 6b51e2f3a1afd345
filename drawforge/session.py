"""Session helpers: settings that the operators rely on, and cutting of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("drawforge")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session() -> SparkSession:
    """The session that runs or that the cluster's settings describe; a local one where there are none."""
    return SparkSession.getActiveSession() or SparkSession.builder.appName("drawforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session.

    Where none is named, a local master gets a folder of its own, which is removed at the end; on a cluster ValueError is
    raised, as executors could not read each other's files. Checkpoints that nothing refers to any more are removed
    where the session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and is read as often as needed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
