"""Folders that driver and executors share, and files in them.

Intermediate tables and archives go below ``spark.checkpoint.dir``.  Every one
gets a folder of its own, so two runs never meet, and a task that is run again
writes files of new names: only names that reach a committed table are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from ..session import ship as ship_code

#: Rows of an Arrow batch at most: texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep their batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship_code(spark)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI for one run of an operator."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, at: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and outlives executors."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; local, HDFS, S3 and GCS alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
