"""A leveled log of what an engine did, and the query figures that are read from it.

Messages go to Python's logging and, from the set level on, to a store; queries and scans are entries of their own.  Entries
wait on the driver, `most` of them at most, and are written together: a message is no Spark job.
"""

from __future__ import annotations

import datetime
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import stats
from ..sources.files import Store

LEVELS = ("debug", "info", "warn", "error")
_LOG = logging.getLogger("brindle")


class Journal:
    def __init__(self, spark: SparkSession, root: str, level: str = "info", most: int = 100):
        self.spark, self.store, self.level, self.most, self._waiting = spark, Store(spark, root, schema.JOURNAL), level, most, []

    def _add(self, level: str, mode: str, action: str, query=None, tool=None, chars=None, results=None, read_after=None, duration_ms=None, details=None) -> None:
        row = (datetime.datetime.now(datetime.UTC), level, mode, action, query, tool, chars, results, read_after, duration_ms, {k: str(v) for k, v in (details or {}).items()})
        self._waiting.append(row)
        if len(self._waiting) >= self.most:
            self.flush()

    def flush(self) -> None:
        if self._waiting:
            rows, self._waiting = self._waiting, []
            self.store.append(self.spark.createDataFrame(rows, schema.JOURNAL).coalesce(1))

    def log(self, level: str, message: str, **details) -> None:
        """Kept where the level is at least the journal's; a level that isn't known is an error."""
        place = LEVELS.index(level)
        _LOG.log(10 * (place + 1), "%s %s", message, details or "")
        if place >= LEVELS.index(self.level):
            self._add(level, "signals", message, details=details)

    def query(self, query: str, mode: str, chars: int, results: int, read_after: bool = False, duration_ms: int = 0) -> None:
        """A query that was answered; mode: signals or baseline (by reading files)."""
        self._add("info", mode, "query_executed", query, "signals_search", chars, results, read_after, duration_ms)

    def indexing(self, duration_ms: int, files_scanned: int, signals_created: int, raw_chars: int, signal_chars: int, reduction_percent: int) -> None:
        self.log("info", "indexing_completed", duration_ms=duration_ms, files_scanned=files_scanned, signals_created=signals_created, raw_source_chars=raw_chars, signal_chars=signal_chars, reduction_percent=reduction_percent)

    def entries(self, level: str = "debug") -> DataFrame:
        """Entries of at least a level, in no order."""
        self.flush()
        return self.store.read().filter(F.col("level").isin(*LEVELS[LEVELS.index(level) :]))

    def metrics(self) -> DataFrame:
        """Averages of the queries by mode, one row."""
        return stats.mode_metrics(self.entries().filter("action = 'query_executed'").select("mode", "chars"))

    def clear(self) -> int:
        self.flush()
        return self.store.clear()
