"""End to end: scan a tree, extract, keep the store, ingest tool output, search, report.

State lives in Parquet stores with manifests, so no step overwrites what it reads; ids are hashes, so reruns agree.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as E
from ..operators import code, lines, merge, retrieval, stats, syntax
from ..sources import files as S
from . import evaluate
from .journal import Journal


def as_store_rows(signals: DataFrame, now=None) -> DataFrame:
    """Signals in the store's schema; the id is the hash of the signal's key."""
    now = now if now is not None else F.current_timestamp()
    have = set(signals.columns)
    pick = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    route = F.col("route") if "route" in have else F.lit(None).cast("struct<method:string,path:string,handler:string>")
    rows = signals.withColumn("route", route)
    key = E.signal_key()
    return rows.select(
        F.sha2(F.concat_ws("|", key, F.coalesce(pick("text", "string"), F.lit(""))), 256).alias("id"), pick("evidence_id", "string").alias("evidence_id"), pick("session_id", "string").alias("session_id"), F.coalesce(pick("kind", "string"), F.lit("function")).alias("kind"),
        F.coalesce(pick("language", "string"), F.lit("unknown")).alias("language"), F.coalesce(pick("file", "string"), F.lit("")).alias("file"), "name", "line_start", "line_end", pick("framework", "string").alias("framework"), "route", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.coalesce(pick("created_at", "timestamp"), now.cast("timestamp")).alias("created_at"), now.cast("timestamp").alias("updated_at"),
    )


SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


class Engine:
    """The public API over one store folder: ingest, scan, warm, search, stats, evaluate, kinds, clear."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        store = lambda name, ddl: S.Store(spark, f"{root}/{name}", ddl)
        self.signals, self.evidence, self.meta, self.log = store("signals", schema.SIGNAL), store("evidence", schema.EVIDENCE), store("file_meta", schema.FILE_META), store("search_log", schema.SEARCH_LOG)
        self.index_meta = store("index_meta", schema.INDEX_META)
        self.index = retrieval.IndexStore(spark, f"{root}/index")
        self.journal = Journal(spark, f"{root}/journal")

    def _keep_evidence(self, rows: DataFrame) -> None:
        """Evidence whose id isn't there yet: a batch that runs again adds nothing."""
        self.evidence.append(merge.merge_insert_only(self.evidence.read(), rows, F.col("id"), ["created_at"]))

    def _replace_signals(self, kept: DataFrame, new: DataFrame) -> None:
        """kept (some of the stored signals) and what is new beside them; the index follows by id."""
        before = self.signals.read()
        fresh = merge.merge_insert_only(kept, new, F.col("id"), ["line_start"])
        self.signals.write(kept.unionByName(fresh.select(*kept.columns)))
        after = self.signals.read()
        gone = before.join(after.select("id"), "id", "left_anti")
        if not gone.isEmpty():
            self.index.remove(gone.select("id"))
        self.index.add(after.join(before.select("id"), "id", "left_anti"))

    def scan(self, tree: str, force: bool = False, rules: schema.ScanRules = schema.ScanRules(), verify_hash: bool = False) -> dict:
        """Index what is new or changed, forget what is gone.  Unchanged files (by time) are listed, never read.

        A file whose structure can't be read gets its signals by patterns; it counts as failed, its error is in `errors` (the first 20).
        """
        began = time.time()
        now = F.current_timestamp()
        listed = S.scan_tree(self.spark, tree, rules, content=False)
        previous = self.meta.read()
        touched = listed.join(previous.select("path", F.col("mtime").alias("_m")), "path", "left").filter(F.lit(force or verify_hash) | F.col("_m").isNull() | (F.col("_m") != F.col("mtime")))
        # Touched files are read once; a lost executor's share is read again.
        read = S.scan_tree(self.spark, tree, rules).join(touched.select("path"), "path", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        hashed = listed.join(read.select("path", "hash"), "path", "left").join(previous.select("path", F.col("hash").alias("_h")), "path", "left").withColumn("hash", F.coalesce("hash", "_h"))
        plan = merge.incremental_plan(hashed, previous, force, verify_hash).persist()
        fresh = read.join(plan.filter("status in ('new', 'changed')"), "path", "left_semi")
        gone = plan.filter("status in ('removed', 'changed')").select("path") if not force else plan.select("path")
        evidence = S.content_evidence(fresh, now)
        scripts = fresh.filter(E.extension("path").isin(*SCRIPTS)).select(F.col("path").alias("file"), "content")
        found = syntax.structural_signals(scripts).persist(StorageLevel.MEMORY_AND_DISK)
        failed = found.filter("kind = 'error'").select("file", F.col("text").alias("error"))
        by_pattern = code.fallback_signals(scripts.join(failed.select("file"), "file", "left_semi"))
        by_pattern = by_pattern.withColumn("route", F.when(F.col("kind") == "route", F.struct("method", "path", F.lit(None).cast("string").alias("handler")))).withColumn("line_end", F.col("line_start")).drop("method", "path", "emit_pos")
        others = fresh.filter(~E.extension("path").isin(*SCRIPTS))
        as_read = others.select(F.col("path").alias("id"), F.lit("").alias("session_id"), F.lit("read").alias("tool"), F.concat(F.lit("<path>"), "path", F.lit("</path>\n"), "content").alias("output"), now.alias("created_at"))
        lined = lines.read_signals(as_read).filter("kind <> 'file_read'").drop("evidence_id")
        new = as_store_rows(found.filter("kind <> 'error'").drop("char_start", "char_end", "emit_pos")).unionByName(as_store_rows(by_pattern)).unionByName(as_store_rows(lined))
        ids = evidence.select("file", F.col("id").alias("_e"))
        new = new.join(ids, "file", "left").withColumn("evidence_id", F.coalesce("_e", "evidence_id")).drop("_e").select(*self.signals.read().columns)
        kept = self.signals.read().join(gone.select(F.col("path").alias("file")), "file", "left_anti").select(*new.columns)
        self._replace_signals(kept, new)
        self._keep_evidence(evidence)
        meta = hashed.select("path", "mtime", "hash", now.alias("indexed_at"))
        self.meta.write(merge.upsert(previous, meta.join(plan.filter("status in ('new', 'changed')"), "path", "left_semi"), "path", plan.filter("status = 'removed'")))
        counters = merge.scan_counters(plan).first().asDict()
        errors = failed.orderBy("file").limit(20).collect()
        counters |= {"failed": failed.count(), "errors": [f"{r['file']}: {r['error']}" for r in errors], "skipped": S.scan_tree(self.spark, tree, rules, content=False, oversize=True).count()}
        for frame in (found, plan, read):
            frame.unpersist()
        size = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        totals = stats.storage(self.signals.read(), size).first()
        self.index_meta.write(self.spark.range(1).select(now.alias("last_indexed_at"), F.lit(self.meta.read().count()).alias("total_files"), F.lit(totals["count"]).cast("bigint").alias("total_signals"), F.lit(size).cast("bigint").alias("raw_source_chars"), F.lit(totals["signal_chars"]).cast("bigint").alias("signal_chars"), F.lit("1").alias("version")))
        took = int(1000 * (time.time() - began))
        self.journal.indexing(took, counters["scanned"], totals["count"], size, totals["signal_chars"], totals["reduction_percent"])
        return counters | {"signals": totals["count"], "signal_chars": totals["signal_chars"], "reduction_percent": totals["reduction_percent"], "duration_ms": took}

    def warm(self, tree: str, rules: schema.ScanRules = schema.ScanRules()) -> dict:
        """What a start does: index a tree that nothing is known of; else say what has drifted, without indexing.

        state: indexed, empty (no files), warm, stale (with the numbers of changed and removed files), or no_metadata
        (signals without file metadata: a forced scan builds the index again).
        """
        if self.meta.read().isEmpty():
            if not self.signals.read().isEmpty():
                return {"state": "no_metadata", "changed": 0, "removed": 0}
            done = self.scan(tree, rules=rules)
            return {"state": "indexed" if done["scanned"] else "empty", "changed": done["to_index"], "removed": 0}
        listed = S.scan_tree(self.spark, tree, rules, content=False).withColumn("hash", F.lit(None).cast("string"))
        drift = merge.scan_counters(merge.incremental_plan(listed, self.meta.read())).first()
        return {"state": "stale" if drift["to_index"] or drift["removed"] else "warm", "changed": drift["to_index"], "removed": drift["removed"]}

    def ingest(self, outputs: DataFrame) -> dict:
        """Signals of tool outputs (TOOL_OUTPUT rows), merged by key; rows that are known are counted and left out."""
        new = as_store_rows(lines.signals(outputs))
        old = self.signals.read()
        counts = merge.merge_counts(old, new, F.col("id")).first().asDict()
        fresh = merge.merge_insert_only(old, new, F.col("id"), ["evidence_id"]).select(*old.columns)
        self.signals.append(fresh)
        after = self.signals.read()
        self.index.add(after.join(old.select("id"), "id", "left_anti"))
        self._keep_evidence(outputs.select("id", F.col("tool").alias("source_type"), F.lit("").alias("file"), F.sha2("output", 256).alias("content_hash"), F.length("output").cast("bigint").alias("raw_size"), "created_at", F.create_map(F.lit("session"), F.coalesce("session_id", F.lit(""))).alias("metadata")))
        return counts

    def search(self, query: str, limit: int = 8, **filters) -> DataFrame:
        """The best signals by the kept index.  They are at most `limit`, so they come to the driver once, for the log and the answer."""
        began = time.time()
        asked = self.spark.createDataFrame([("q", query)], "qid string, query string")
        found = retrieval.hybrid_search(self.signals.read(), asked, schema.Search(limit=limit), index=self.index.read(), **filters).orderBy("rank")
        rows = found.collect()
        self.journal.query(query, "signals", sum(len(r["text"]) for r in rows), len(rows), duration_ms=int(1000 * (time.time() - began)))
        self.log.append(self.spark.range(1).select(F.lit(query).alias("query"), F.lit(len(rows)).alias("results_count"), F.current_timestamp().alias("ts")))
        if self.log.read().count() > 1000:
            self.log.write(stats.trimmed(self.log.read(), "ts", "query").select(*self.log.read().columns))
        return self.spark.createDataFrame(rows, found.schema)

    def stats(self) -> DataFrame:
        meta = self.index_meta.read().unionByName(self.spark.sql("select timestamp'1970-01-01' as last_indexed_at, 0L as total_files, 0L as total_signals, 0L as raw_source_chars, 0L as signal_chars, '' as version")).orderBy(F.col("last_indexed_at").desc()).limit(1)
        held = self.evidence.read().agg(F.count("*").alias("evidence_count"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("evidence_bytes"))
        return stats.tool_stats(self.signals.read(), meta, self.log.read()).crossJoin(held)

    def evaluate(self, tree: str, queries: DataFrame, rules: schema.ScanRules = schema.ScanRules(), mode: str = "agent") -> tuple[DataFrame, str]:
        """Metrics and report of queries (as ground_truth gives them) over a tree and its signals; mode: agent, real or simulated."""
        files = S.scan_tree(self.spark, tree, rules).select("path", "content")
        # Only paths meet in one task: a tree's files are numbered in their order.
        places = files.select("path").withColumn("ordinal", F.row_number().over(Window.orderBy("path")) - 1)
        files = files.join(places, "path")
        signals = self.signals.read().select("kind", "name", "file", F.col("line_start").alias("line"), "text", F.xxhash64("id").alias("pos"))
        return evaluate.benchmark_suite(queries, signals, files, mode)

    def kinds(self) -> DataFrame:
        return self.spark.createDataFrame([(i, k) for i, k in enumerate(schema.KINDS)], "position int, kind string")

    def clear(self) -> dict:
        self.index.clear()
        self.journal.clear()
        return {name: getattr(self, name).clear() for name in ("signals", "evidence", "meta", "log", "index_meta")}
