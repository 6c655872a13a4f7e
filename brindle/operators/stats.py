"""Statistics: store contents, search logs, scans, benchmark metrics.  Each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def counts_by(signals: DataFrame, columns: tuple[str, ...] = ("kind", "language", "framework")) -> DataFrame:
    """(dimension, value, n) of each column's values in one pass; null kinds count, other nulls and empties don't."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns))
    rows = signals.select(F.explode(pairs).alias("p")).select("p.*").filter((F.col("dimension") == "kind") | (F.coalesce("value", F.lit("")) != ""))
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def grouping_sets(signals: DataFrame) -> DataFrame:
    """Counts and characters by kind, by language, by framework and in all, by GROUPING SETS."""
    return signals.groupingSets([["kind"], ["language"], ["framework"], []], "kind", "language", "framework").agg(
        F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


def storage(signals: DataFrame, raw_chars: Column | int) -> DataFrame:
    """(count, signal_chars, raw_source_chars, reduction_percent)."""
    raw = raw_chars if isinstance(raw_chars, Column) else F.lit(raw_chars).cast("bigint")
    totals = signals.agg(F.count("*").alias("count"), _sum(F.length("text")).alias("signal_chars")).withColumn("raw_source_chars", raw)
    return totals.withColumn("reduction_percent", E.reduction(F.col("raw_source_chars"), F.col("signal_chars")))


def last_rows(log: DataFrame, n: int, order: str = "ts", tie: str | None = None) -> DataFrame:
    """The n last rows of a log: a top-n, never a sort of all."""
    keys = [F.col(order).desc(), *([F.col(tie).desc()] if tie else [])]
    return log.orderBy(*keys).limit(n)


def trimmed(log: DataFrame, order: str, tie: str, most: int = 1000, keep: int = 500) -> DataFrame:
    """The log, or its last `keep` rows when it has more than `most`: the count is a scalar subquery, the cut a top-n."""
    total = log.agg(F.count("*").alias("_n"))
    tail = last_rows(log, most + 1, order, tie).withColumn("_r", F.row_number().over(Window.orderBy(F.col(order).desc(), F.col(tie).desc())))
    return tail.crossJoin(F.broadcast(total)).filter((F.col("_n") <= most) | (F.col("_r") <= keep)).drop("_n", "_r")


def search_stats(log: DataFrame, order: str = "ts", tie: str | None = None) -> DataFrame:
    """One row over (query, results_count, ts): totals, mean results, zero results, and top3_hit_rate.

    top3_hit_rate is the share of the last 3 searches with 3 results or more, or, of fewer searches, of those with any.
    """
    all_ = log.agg(F.count("*").alias("n"), _sum("results_count").alias("total"), _sum((F.col("results_count") == 0).cast("int")).alias("zero"), _sum((F.col("results_count") >= 1).cast("int")).alias("some"))
    tail = last_rows(log, 3, order, tie).agg(_sum((F.col("results_count") >= 3).cast("int")).alias("hits"))
    rate = F.when(F.col("n") >= 3, F.col("hits") / 3 * 100).when(F.col("n") > 0, F.col("some") / F.col("n") * 100).otherwise(0.0)
    mean = F.when(F.col("n") > 0, E.half_up(F.col("total") / F.col("n") * 10) / 10.0).otherwise(0.0)
    return all_.crossJoin(F.broadcast(tail)).select(F.col("n").alias("total_searches"), mean.alias("avg_results"), E.half_up(rate).alias("top3_hit_rate"), F.col("zero").alias("zero_result_queries"))


def full_metrics(baseline: DataFrame, signals: DataFrame, raw_chars: Column, signal_chars: Column, full_reads: bool = True) -> DataFrame:
    """(metric, before, after, reduction, success) of two runs.

    Runs are rows of (tokens, full_reads, tool_calls, correctness[, top3_hit]); means are rounded as the reports do.
    full_reads=False leaves that metric out, as the real-mode report does.
    """
    mean_tokens = F.when(F.count("*") > 0, E.half_up(F.sum("tokens") / F.count("*"))).otherwise(0)
    mean_correct = F.when(F.count("*") > 0, E.decimals(F.sum("correctness") / F.count("*"))).otherwise(0.0)
    b = baseline.agg(mean_tokens.alias("bt"), _sum("full_reads").alias("br"), _sum("tool_calls").alias("bc"), mean_correct.alias("ba"))
    hits = F.when(F.count("*") > 0, E.decimals(_sum(F.col("top3_hit").cast("int")) * 100 / F.count("*"), 1)).otherwise(0.0)
    s = signals.agg(mean_tokens.alias("st"), _sum("full_reads").alias("sr"), _sum("tool_calls").alias("sc"), mean_correct.alias("sa"), hits.alias("hit"))
    one = b.crossJoin(F.broadcast(s)).withColumn("raw", raw_chars).withColumn("chars", signal_chars)
    c, d = F.col, lambda x: x.cast("double")
    savings = c("bt") - c("st")
    even = E.break_even(c("raw"), savings)

    def row(name: str, before, after, reduction, success) -> Column:
        return F.struct(F.lit(name).alias("metric"), d(before).alias("before"), d(after).alias("after"), d(reduction).alias("reduction"), success.alias("success"))

    rows = [
        row("storage", c("raw"), c("chars"), E.reduction(c("raw"), c("chars")), c("chars") < c("raw")),
        row("query_context", c("bt"), c("st"), E.reduction(c("bt"), c("st")), E.reduction(c("bt"), c("st")) >= 20),
        row("full_file_reads", c("br"), c("sr"), E.reduction(c("br"), c("sr")), E.reduction(c("br"), c("sr")) > 0),
        row("tool_calls", c("bc"), c("sc"), E.reduction(c("bc"), c("sc")), E.reduction(c("bc"), c("sc")) > 0),
        row("accuracy", c("ba"), c("sa"), F.lit(0), c("sa") >= c("ba") - 0.3),
        row("retrieval", F.lit(0), c("hit"), c("hit"), c("hit") >= 70),
        row("break_even", savings, even, F.lit(0), (savings > 0) & (even < 50)),
    ]
    if not full_reads:
        rows.pop(2)
    return one.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def runner_accuracy(results: DataFrame, position: str = "position", correct: str = "correct") -> DataFrame:
    """Accuracy, and correct ones among the first 3 and 5 queries (by place, as the reports count them)."""
    ok = F.col(correct).cast("int")
    one = results.agg(F.count("*").alias("total"), _sum(ok).alias("correct"), _sum(F.when(F.col(position) < 3, ok)).alias("first3"), _sum(F.when(F.col(position) < 5, ok)).alias("first5"))
    share = F.col("correct") / F.col("total")
    return one.select(
        "total", "correct", E.half_up(share * 100).alias("accuracy_percent"), (share >= 0.7).alias("accuracy_ok"), "first3", "first5",
        ((F.col("first3") / F.col("total") >= 0.6) | (F.col("first5") / F.col("total") >= 0.8)).alias("retrieval_ok"),
    )


def mode_metrics(log: DataFrame, indexing_chars: int = 12000) -> DataFrame:
    """Averages of a query log by mode (signals, baseline) over (mode, chars), and where indexing has paid."""
    n = lambda m: _sum((F.col("mode") == m).cast("int"))
    chars = lambda m: _sum(F.when(F.col("mode") == m, F.col("chars")))
    one = log.agg(F.count("*").alias("total_queries"), n("signals").alias("signal_queries"), n("baseline").alias("baseline_queries"), chars("signals").alias("signal_chars"), chars("baseline").alias("baseline_chars"))
    mean = lambda total, count: F.when(F.col(count) > 0, E.half_up(F.col(total) / F.col(count))).otherwise(F.lit(0).cast("bigint"))
    one = one.withColumn("avg_signal_chars", mean("signal_chars", "signal_queries")).withColumn("avg_baseline_chars", mean("baseline_chars", "baseline_queries"))
    one = one.withColumn("reduction_percent", E.reduction(F.col("baseline_chars"), F.col("signal_chars")))
    return one.withColumn("break_even", E.break_even(F.lit(indexing_chars), F.col("avg_baseline_chars") - F.col("avg_signal_chars"), never=0))


def tool_stats(signals: DataFrame, index_meta: DataFrame, log: DataFrame, order: str = "ts", tie: str | None = None) -> DataFrame:
    """The stats report's derived figures and statuses, one row.  index_meta: one row of (total_files, raw_source_chars)."""
    one = signals.agg(F.count("*").alias("total_signals"), _sum(F.length("text")).alias("signal_chars"))
    one = one.crossJoin(F.broadcast(index_meta.select("total_files", "raw_source_chars"))).crossJoin(F.broadcast(search_stats(log, order, tie)))
    raw, files = F.col("raw_source_chars"), F.greatest(F.col("total_files"), F.lit(1))
    savings = F.when((raw > 0) & (F.col("total_searches") > 0), E.half_up(raw / F.col("total_searches"))).otherwise(F.lit(0).cast("bigint"))
    before = F.when(raw > 0, E.half_up(raw / files)).otherwise(F.lit(0).cast("bigint"))
    after = E.half_up(F.col("signal_chars") / files)
    one = one.withColumn("reduction_percent", E.reduction(raw, F.col("signal_chars"))).withColumn("avg_savings", savings)
    one = one.withColumn("break_even", F.when(F.col("avg_savings") > 0, E.half_up(raw / F.col("avg_savings"))).otherwise(F.lit(0).cast("bigint")))
    one = one.withColumn("per_query_before", before).withColumn("per_query_after", after).withColumn("token_savings_percent", E.reduction(F.col("per_query_before"), F.col("per_query_after")))
    return one.withColumn("storage_status", E.storage_status(F.col("reduction_percent"))).withColumn("retrieval_status", E.retrieval_status(F.col("top3_hit_rate"))).withColumn("break_even_status", E.break_even_status(F.col("break_even")))


def mock_indexing(files: DataFrame, content: str = "content") -> DataFrame:
    """The indexing figures that the simulated suite assumes: 15 % of the characters."""
    one = files.agg(_sum(F.length(content)).alias("raw_source_chars"), F.count("*").alias("files"))
    return one.withColumn("signal_chars", E.half_up(F.col("raw_source_chars") * 0.15)).withColumn("reduction_percent", E.reduction(F.col("raw_source_chars"), F.col("signal_chars")))


# How many signals a file the simulated suite assumes.
MOCK_COUNTS = (
    ("kind", "function", 3.0), ("kind", "class", 0.8), ("kind", "route", 2.0), ("kind", "import", 4.0), ("kind", "middleware", 0.5),
    ("language", "typescript", 10.0), ("language", "javascript", 0.0), ("framework", "express", 2.0),
)


def mock_counts(files: DataFrame) -> DataFrame:
    """(dimension, value, n) of the signals that the simulated suite assumes: multiples of the number of files, rounded."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), E.half_up(F.col("files") * F.lit(x)).alias("n")) for d, v, x in MOCK_COUNTS))
    return files.agg(F.count("*").alias("files")).select(F.inline(rows))


def compact_sizes(signals: DataFrame) -> DataFrame:
    """Characters of signals as text, as JSON objects, and as kind:name pairs."""
    pair = F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit("")))
    return signals.agg(_sum(F.length("text")).alias("text_chars"), _sum(F.length(F.to_json(F.struct("kind", "name", "file", "text")))).alias("json_chars"), (_sum(F.length(pair)) + F.greatest(F.count("*") - 1, F.lit(0))).alias("compact_chars"))
