"""Keyed relations: first-wins dedup, insert-only merge, change plans, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key.  Ranks before the shuffle too (the plan's WindowGroupLimit), so a hot key sends one row a task."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = rows.select("*", *((F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(key, names, strict=True)))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return keyed.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", *names)


def merge_insert_only(existing: DataFrame, new: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """New rows whose key is not there yet, the first of equal ones.  Rows of existing keys are left out, not applied."""
    fresh = first_wins(new, [key], order)
    return fresh.withColumn("_key", key).join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def merge_counts(existing: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """(created, updated): new keys, and new rows whose key was there or came before among the new."""
    keyed = new.groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    old = existing.select(key.alias("_key")).distinct().withColumn("_old", F.lit(True))
    seen = keyed.join(old, "_key", "left")
    created = F.coalesce(F.sum(F.when(F.col("_old").isNull(), 1)), F.lit(0)).cast("bigint")
    return seen.agg(created.alias("created"), (F.coalesce(F.sum("n"), F.lit(0)) - created).cast("bigint").alias("updated"))


def incremental_plan(current: DataFrame, previous: DataFrame, force: bool = False, verify_hash: bool = False) -> DataFrame:
    """(path, status): new, changed, unchanged or removed.

    Equal times mean unchanged without a look at hashes (verify_hash looks); with other times equal hashes do.
    force: everything is indexed anew and nothing removed.
    """
    c, p = current.select("path", F.col("mtime").alias("c_m"), F.col("hash").alias("c_h")), previous.select("path", F.col("mtime").alias("p_m"), F.col("hash").alias("p_h"))
    both = c.withColumn("_c", F.lit(True)).join(p.withColumn("_p", F.lit(True)), "path", "full_outer")
    same = (F.col("c_h") == F.col("p_h")) if verify_hash else (F.col("c_m") == F.col("p_m")) | (F.col("c_h") == F.col("p_h"))
    status = F.when(F.col("_c").isNull(), "removed").when(F.col("_p").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    out = both.select("path", status.alias("status"))
    if force:
        out = out.filter("status <> 'removed'").withColumn("status", F.when(F.col("status") == "new", "new").otherwise("changed"))
    return out


def removed(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select("path").join(current.select("path"), "path", "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """Existing rows replaced by new ones of the same key, without those in `gone`."""
    kept = existing.join(new.select(key), key, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(key), key, "left_anti")
    return kept.unionByName(new)


def partial_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Columns of new where they aren't null, else those of old."""
    n = new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    joined = old.join(n, old[key] == F.col("_k"), "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), old[c]).alias(c) if c != key and c in new.columns else old[c] for c in old.columns))


def scan_counters(plan: DataFrame) -> DataFrame:
    """One row: files scanned, to index, unchanged, removed."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("bigint")), F.lit(0)).cast("bigint")
    return plan.agg(n("new", "changed", "unchanged").alias("scanned"), n("new", "changed").alias("to_index"), n("unchanged").alias("up_to_date"), n("removed").alias("removed"))


def remove_by_file(signals: DataFrame, file: str) -> DataFrame:
    return signals.filter((F.col("file") != file) | F.col("file").isNull())
