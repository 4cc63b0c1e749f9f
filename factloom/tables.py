"""Reading tables, and intermediates that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without one, and gets a temporary folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def intermediates(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"


def grown(df: DataFrame) -> DataFrame:
    """df as a side of a join with another table that grows with the project as it does: both are dealt and sorted. Spark plans by bytes on disk, of which a compressed table of
    facts has a small part of what it takes in memory, and would otherwise gather and broadcast it through the driver."""
    return df.hint("merge")


#: How often intermediates were deleted; what remembers frames over them compares it.
CLEANED = [0]


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; to be called when no frame that came from them is needed any more."""
    CLEANED[0] += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again; cuts its lineage."""
    path = f"{intermediates(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
