"""Tables that a job writes for itself: what several steps read is computed once, and is neither
recomputed by a second reader nor lost with an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one
    machine (tests) takes a folder in the warehouse; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_fairlead").rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's own tables."""
    return f"{shared_folder(spark)}/fairlead-{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Deletes all tables that this application has ``written`` and not discarded: results that are not yet read or
    stored elsewhere can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; it cuts the lineage. options: of the
    Parquet writer."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
