"""Tables written to the shared folder, to cut lineage so that a lost executor costs one scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests); else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete the folder when the driver's JVM ends."""
    target, files = _path(spark, path)
    files.deleteOnExit(target)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; its plan is then one scan.

    The folder is deleted by discard(), or when the driver's JVM ends.
    """
    path = f"{shared_dir(df.sparkSession)}/wayfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    delete_at_end(df.sparkSession, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for t in tables:
        if getattr(t, "_wayfold_path", None):
            target, files = _path(t.sparkSession, t._wayfold_path)
            files.delete(target, True)
