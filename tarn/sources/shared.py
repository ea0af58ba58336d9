"""Tables in the folder that driver and executors share: results of one step that the next ones read, so lost executors cost little."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a folder of the application under /tmp on a local master, as in tests; on a cluster that is an
    error, as a folder of one machine would lose what others write."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage is cut there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def release(df: DataFrame | None) -> None:
    """Removes the table of a DataFrame that materialize() gave. For a step's own tables, once nothing that is still to run reads them."""
    path = getattr(df, "stored_at", None) if df is not None else None
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
