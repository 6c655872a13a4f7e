"""Streams: files that appear in a folder, and tool outputs, merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..schema import TOOL_OUTPUT


def tool_output_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Tool outputs as JSON lines appear in a folder."""
    return spark.readStream.schema(TOOL_OUTPUT).option("maxFilesPerTrigger", per_trigger).json(folder)


def ingest_stream(stream: DataFrame, engine: Engine, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge every micro-batch into the engine's store.  The merge leaves known keys out, so a batch that runs again
    after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        engine.ingest(batch)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Searches and their mean results by window of event time; rows later than `late` are left out."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count("*").alias("searches"), F.avg("results_count").alias("avg_results")).select("window.start", "searches", "avg_results")
