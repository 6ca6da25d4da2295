"""Session conventions: UTC event time and a reliable checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; every operator works in UTC event time.  Nothing else of a session is touched."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session (tests, development)
    may fall back to a folder of its own; on a cluster an unset folder is an error, because a
    machine-local one would not outlive the executor that wrote it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="tracewarden-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written as compressed columns to the shared folder and read again, and the path for ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *kept: DataFrame | str) -> None:
    """Deletes what ``cut_lineage`` or ``stage`` wrote and nothing reads any more.

    Shuffle files go with the plans that made them once the driver's garbage is collected, which a driver with a large
    heap may not do before the disk is full; so it is asked to.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in kept:
        if isinstance(x, DataFrame):
            file = x._jdf.queryExecution().logical().rdd().getCheckpointFile()
            x = file.get() if file.isDefined() else None
        if x:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
    jvm.java.lang.System.gc()
