"""Cut a plan's lineage with a table in the shared checkpoint folder.

A written table outlives the executors that made it, is read back with column pruning, and is evaluated
once however many branches read it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="catalens-")
    spark.conf.set(_CONF, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """Unused path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/catalens/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is read in fewer splits than there are cores.

    For CPU-bound work on a plain scan (asking for the splits of a plan with shuffles would run it). A
    large table has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
