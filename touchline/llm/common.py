"""What the operators of this subpackage share: table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between Spark and Python. Texts are thousands of bytes, so Spark's default of
#: 10,000 rows holds tens of megabytes several times over in each task.
BATCH_ROWS = 1000
#: Rows that the Parquet reader decodes at a time; at Spark's 4,096 a text column's buffer doubles up to tens of megabytes.
READER_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS and the Parquet reader's to READER_ROWS unless they
    are lower already. The settings are read when a query is planned, so they stay."""
    for key, most, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS, "4096")):
        now = int(spark.conf.get(key, usual))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where a session on
    one machine names none, as in tests, a local one is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = getattr(spark, "_touchline_scratch", None) or tempfile.mkdtemp(prefix="touchline-")
        spark._touchline_scratch = found
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.
    A lost executor then repeats a read, not the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/touchline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; its files go when the frame is no longer in use."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
