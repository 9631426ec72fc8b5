"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoints import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that later steps start from the table.

    Columns are stored compressed and can be read one by one, which a checkpoint cannot.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows of an Arrow batch: they hold whole texts, so Spark's own 10,000 would be much memory in every task.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context, and bounds the session's Arrow batches.

    The first is needless where it is installed on them; the archive is a driver file that Spark distributes.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_sievecraft_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='run-')}/{package.name}"
    context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
    context._sievecraft_shipped = True
