"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session sets it; a local folder only where it does not and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        folder = _local[0]
    return folder.rstrip("/") + "/tessera"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all stored tables; call when no DataFrame over them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
