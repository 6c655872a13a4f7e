"""Settings and small frame helpers that several operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names.

    Where spark.checkpoint.dir is unset a folder of this machine is set if there is no other (master local[...]); on a cluster it is an error.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return frame.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes that a Python worker gets at a time: whole texts are long, and memory beside the heap is small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
