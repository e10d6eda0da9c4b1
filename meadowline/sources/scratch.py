"""Tables written between steps, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where everything runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/meadowline/{uuid.uuid4().hex}"


def kept(df: DataFrame, *partitioned: str) -> DataFrame:
    """``df`` computed once and read back, perhaps by the values of columns: a lineage cut that survives lost executors, whose
    size Spark knows."""
    path = scratch_dir(df.sparkSession)
    (df.write.partitionBy(*partitioned) if partitioned else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
