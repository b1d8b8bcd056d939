"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs in one process (tests), a temporary folder is taken.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-mintleaf-"))
    return _own_dir[0]


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/mintleaf/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores where its scan has fewer splits than there are; for work on texts of small tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discard_tables(spark: SparkSession) -> None:
    """Deletes all tables that this application has ``written``; for callers that have used up the results."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
