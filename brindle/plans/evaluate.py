"""Evaluation of retrieval: query sets, runners over signals and files, comparisons, validation, reports.

All runners are joins of a bounded query set with signals or files; ties go by an explicit position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules
from ..operators import stats

# The default and the navigation queries: (query, kind, method, part of the file).
DEFAULT_QUERIES = (
    ("Where is the main app initialized?", "function", None, None),
    ("Show all routes in this project", "route", None, None),
    ("Where is the login handler?", "function", None, None),
    ("Find the upload route", "route", None, None),
    ("Find POST /upload", "route", "POST", None),
    ("Show middleware chain", "middleware", None, None),
    ("Where is error handling defined?", "function", None, None),
    ("What imports are used in the main app file?", "import", None, None),
    ("Where is the API endpoint defined?", "route", None, None),
    ("Find the main service/model/controller definition", "class", None, None),
)
NAVIGATION_QUERIES = (
    ("Where is upload handled?", "route", None, "upload"),
    ("Find database model", "class", None, "model"),
    ("Show authentication middleware", "middleware", None, None),
    ("Find POST endpoint", "route", "POST", None),
    ("Where is the router defined?", "route", None, None),
)

_QUERY = "id string, query string, kind string, method string, file_contains string"


def query_set(spark: SparkSession, name: str = "default") -> DataFrame:
    return spark.createDataFrame([(f"q{i}", *q) for i, q in enumerate(DEFAULT_QUERIES if name == "default" else NAVIGATION_QUERIES)], _QUERY)


def _contained(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def _lower(*parts: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def meets(kind: Column, name: Column, file: Column, expected: Column) -> Column:
    """Whether a signal is what a query expects: kind, handler (either name holds the other) and file."""
    handler = F.lower(F.coalesce(expected["handler"], F.lit("")))
    n = F.lower(F.coalesce(name, F.lit("")))
    kind_ok = (F.coalesce(expected["kind"], F.lit("")) == "") | (kind == expected["kind"])
    handler_ok = (handler == "") | F.contains(n, handler) | F.contains(handler, n)
    file_ok = (F.coalesce(expected["file"], F.lit("")) == "") | F.contains(file, expected["file"])
    return kind_ok & handler_ok & file_ok


def signal_matches(queries: DataFrame, signals: DataFrame, most: int) -> DataFrame:
    """Signals that hold a search term of a query, by the number of terms in kind and name, then position; the first `most`.

    queries: (id, query, expected, ...), a bounded set sent to the signals' tasks; signals: (kind, name, file, line, text, pos).
    """
    asked = queries.withColumn("terms", E.search_terms("query"))
    text = _lower("kind", "name", "file")
    found = signals.crossJoin(F.broadcast(asked)).filter(F.exists("terms", lambda t: F.contains(text, t)))
    ranked = found.withColumn("hits", _contained(F.col("terms"), _lower("kind", "name")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("hits").desc(), F.col("pos").asc()))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= most)


def signal_benchmark(queries: DataFrame, signals: DataFrame) -> DataFrame:
    """Per query: count, chars_read, tokens, correctness (3 first, 2 among three, 1 any, 0 none) and the first three results."""
    top = signal_matches(queries, signals, 5).withColumn("ok", meets(F.col("kind"), F.col("name"), F.col("file"), F.col("expected")))
    first = F.col("rank") == 1
    chars = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 50).otherwise(F.length("text"))
    shown = F.when(F.col("rank") <= 3, F.struct("rank", "file", "line", "kind", "name"))
    per = top.groupBy("id").agg(
        F.count("*").alias("count"), F.max(F.when(first, chars)).alias("chars_read"), F.max((first & F.col("ok")).cast("int")).alias("one"), F.max(((F.col("rank") <= 3) & F.col("ok")).cast("int")).alias("three"), F.array_sort(F.collect_list(shown)).alias("results")
    )
    out = queries.select("id").join(per, "id", "left")
    grade = F.when(F.col("one") == 1, 3).when(F.col("three") == 1, 2).when(F.col("count") > 0, 1).otherwise(0)
    return out.select("id", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("chars_read", F.lit(0)).cast("bigint").alias("chars_read"), E.token_estimate(F.coalesce("chars_read", F.lit(0))).alias("tokens"), grade.alias("correctness"), F.coalesce("results", F.array().cast(dict(per.dtypes)["results"])).alias("results"))


def real_signals(queries: DataFrame, signals: DataFrame) -> DataFrame:
    """Per query: correctness 3 (first result is right), 1.5 (something found), 0; top3_hit as soon as anything matched."""
    top = signal_matches(queries, signals, 1)
    right = meets(F.col("kind"), F.col("name"), F.col("file"), F.col("expected"))
    chars = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 50).otherwise(F.length("text"))
    per = top.select("id", F.when(right, 3.0).otherwise(1.5).alias("correctness"), chars.cast("bigint").alias("chars_read"))
    out = queries.select("id").join(per, "id", "left")
    read = F.coalesce("chars_read", F.lit(0)).cast("bigint")
    return out.select("id", F.coalesce("correctness", F.lit(0.0)).alias("correctness"), read.alias("chars_read"), E.token_estimate(read).alias("tokens"), F.col("correctness").isNotNull().alias("top3_hit"))


def _handler_ok(content: Column, expected: Column) -> Column:
    h, kind, text = F.lower(F.coalesce(expected["handler"], F.lit(""))), expected["kind"], F.lower(content)
    named = (h == "") | F.contains(text, h)
    declared = (h == "") | F.contains(text, F.concat(F.lit("class "), h)) | F.contains(text, F.concat(F.lit("interface "), h))
    middleware = F.contains(text, F.lit("middleware")) | F.contains(text, F.lit("use("))
    return F.when(kind.isin("function", "route"), named).when(kind.isin("class", "interface"), declared).when(kind == "middleware", middleware).otherwise(True)


def agent_baseline(queries: DataFrame, files: DataFrame) -> DataFrame:
    """What an agent reads that goes by file names: per query full and targeted reads, characters, tokens, correctness 0-3.

    files: (path, content, ordinal); the ordinal decides ties, so it has to be the enumeration order.
    """
    asked = queries.withColumn("terms", E.search_terms("query")).withColumn("head", F.array_join(F.slice(F.split(F.lower("query"), " "), 1, 2), " "))
    f = files.withColumn("base", F.lower(E.basename("path"))).withColumn("chars", F.length("content").cast("bigint"))
    pairs = f.crossJoin(F.broadcast(asked))
    want = F.lower(F.coalesce("expected.file", F.lit("")))
    bare = F.transform("terms", lambda t: F.regexp_replace(t, "['’]", ""))
    near = F.exists(bare, lambda t: F.contains("base", t) | F.contains("path", t)) | (F.size("terms") > 0) & F.contains("base", "head")
    found = pairs.filter(((want == "") | F.contains("path", want)) & near)
    weight = _contained(F.col("terms"), F.col("base")) + (F.contains("base", F.lit("route")) | F.contains("base", F.lit("handler"))).cast("int")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(weight.desc(), F.col("ordinal").asc()))).filter("rank <= 3")
    ok_file = (F.coalesce("expected.file", F.lit("")) == "") | F.contains("path", "expected.file")
    ranked = ranked.withColumn("ok_file", ok_file).withColumn("ok_handler", _handler_ok(F.col("content"), F.col("expected")))
    first = F.col("rank") == 1
    at = lambda c: F.max(F.when(first, F.col(c).cast("int")))
    per = ranked.groupBy("id").agg(at("ok_file").alias("ok_file"), at("ok_handler").alias("ok_handler"), F.max(F.when(first, F.col("chars"))).alias("c1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("chars"))), F.lit(0)).alias("c2"), F.sum("chars").alias("c3"), F.max("rank").alias("n"))
    lost = F.broadcast(files.orderBy("ordinal").limit(5).agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("lost"), F.count("*").alias("lost_n")))
    out = queries.select("id").join(per, "id", "left").crossJoin(lost)
    grade = F.when(F.col("n").isNull(), 0).when((F.col("ok_file") == 1) & (F.col("ok_handler") == 1), 3).when(F.col("ok_file") == 1, 2).otherwise(1)
    out = out.withColumn("correctness", grade)
    by = lambda three, two, one, zero: F.when(grade == 3, three).when(grade == 2, two).when(grade == 1, one).otherwise(zero).cast("bigint")
    chars = by(F.col("c1") * 2, F.col("c1") + F.col("c2"), F.col("c1") + F.col("c3"), F.col("lost"))
    return out.select(
        "id", F.lit(1).alias("tool_calls"), by(F.lit(1), F.least("n", F.lit(2)) - 1, F.col("n"), F.col("lost_n")).alias("full_reads"),
        F.col("n").isNotNull().cast("int").alias("targeted_reads"), chars.alias("chars_read"), E.token_estimate(chars).alias("tokens"), "correctness",
    )


def real_baseline(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Reading by keyword: the first file whose name or path holds a term, then the first five files of the tree."""
    asked = queries.withColumn("terms", E.search_terms("query", rules.STOP_WORDS_SHORT)).withColumn("q", F.lower("query"))
    f = files.withColumn("chars", F.length("content").cast("bigint")).withColumn("low", F.lower("content"))
    near = F.exists("terms", lambda t: F.contains(F.lower(E.basename("path")), t) | F.contains("path", F.regexp_replace(t, "['’]", "")))
    h, kind = F.lower(F.coalesce("expected.handler", F.lit(""))), F.col("expected.kind")
    words = F.filter(F.split("q", " "), lambda w: F.length(w) > 3)
    said = _contained(words, F.col("low")) >= F.greatest(F.lit(1), F.floor(F.size(words) * 0.5))
    handler = F.when(kind.isin("function", "route"), (h == "") | F.contains("low", h)).when(kind == "class", (h == "") | F.contains("low", F.concat(F.lit("class "), h))).otherwise(True)
    matched = ((F.coalesce("expected.file", F.lit("")) == "") | F.contains("path", "expected.file")) & handler & said
    pairs = f.crossJoin(F.broadcast(asked)).withColumn("near", near).withColumn("matched", matched)
    first = pairs.filter("near").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))).filter("r = 1").select("id", F.col("chars").alias("c1"), F.col("matched").alias("m1"))
    head = F.array_join(F.slice(F.split("q", " "), 1, 3), " ")
    five = pairs.filter("ordinal < 5").groupBy("id").agg(F.sum("chars").alias("c5"), F.count("*").alias("n5"), F.sum(F.contains("low", head).cast("int")).alias("t5"))
    e = F.col("expected")
    out = queries.select("id", "category", "expected").join(first, "id", "left").join(five, "id", "left")
    got = F.col("c1").isNotNull()
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    half = lambda c: F.when(F.coalesce(c, F.lit(False)), 0.5).otherwise(0.0)
    grade = F.least(F.lit(3.0), F.lit(1.0) + half(e["kind"].isin("function", "route", "class", "middleware")) + half(F.coalesce(e["file"], F.lit("")) != "") + half(e["lineRequired"]) + half(F.col("category").isin("navigation", "route_discovery")))
    chars = n("c1") + F.when(F.col("m1"), n("c1") * 2).otherwise(0) + n("c5")
    return out.select(
        "id", (F.lit(1) + got.cast("int") + n("n5")).cast("bigint").alias("tool_calls"), (F.coalesce(F.col("m1").cast("int"), F.lit(0)) + F.when(got, n("t5")).otherwise(0)).cast("bigint").alias("full_reads"),
        (got.cast("int") + n("t5")).cast("bigint").alias("targeted_reads"), chars.alias("chars_read"), E.token_estimate(chars).alias("tokens"), F.when(got, grade).otherwise(0.0).alias("correctness"),
    )


def top1_accuracy(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(id, correct): whether the first result has the kind, or the method, or the part of the file that is expected.

    queries: (id, kind, method, file_contains); results: (qid, rank, kind, route, file).
    """
    first = results.filter("rank = 1").select(F.col("qid").alias("id"), F.col("kind").alias("r_kind"), F.col("route.method").alias("r_method"), F.col("file").alias("r_file"))
    one = lambda c: F.coalesce(c, F.lit(False))
    parts = one(F.col("kind") == F.col("r_kind")) | one(F.upper("method") == F.upper("r_method")) | one(F.contains(F.col("r_file"), F.col("file_contains")))
    return queries.join(first, "id", "left").select("id", parts.alias("correct"))


def _noise(seed: int, what: str) -> Column:
    """A number in [0, 1) that follows from the seed, what it is for, and the query's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), "id")), 1, 8), 16, 10).cast("bigint") % 1000 / 1000.0


def simulated_baseline(queries: DataFrame, total_files: int, total_chars: int, seed: int = 0) -> DataFrame:
    """Reading with noise, as the simulated mode has it; the noise is seeded, so reruns agree."""
    reads = (F.lit(2) + F.floor(_noise(seed, "reads") * 4)).cast("bigint")
    chars = E.half_up(reads * (total_chars / max(total_files, 1)) * (0.8 + 0.4 * _noise(seed, "size")))
    return queries.select("id", (reads + 1).alias("tool_calls"), reads.alias("full_reads"), chars.alias("chars_read"), E.token_estimate(chars).alias("tokens"), E.decimals(1.0 + _noise(seed, "grade")).alias("correctness"))


def totals(results: DataFrame) -> DataFrame:
    """One row of a run: sums, the rounded mean of tokens, mean correctness and the share of correctness 2 or more."""
    n = F.count("*")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return results.agg(
        s("chars_read").alias("total_chars"), s("tokens").alias("total_tokens"), F.when(n > 0, E.half_up(s("tokens") / n)).otherwise(0).cast("bigint").alias("avg_tokens"),
        F.when(n > 0, E.decimals(F.sum("correctness") / n)).otherwise(0.0).alias("avg_correctness"), F.when(n > 0, E.decimals(s((F.col("correctness") >= 2).cast("int")) * 100 / n, 1)).otherwise(0.0).alias("top3_hit_rate"),
    )


def comparison(baseline: DataFrame, signals: DataFrame, raw_chars: Column, n_signals: Column) -> DataFrame:
    """(metric, baseline, signals, reduction, success) of an agent's reading against signals; a signal counts 50 characters."""
    b = totals(baseline).select(F.col("total_chars").alias("b_chars"), F.col("avg_tokens").alias("b_tokens"), F.col("avg_correctness").alias("b_ok")).crossJoin(F.broadcast(baseline.agg(F.coalesce(F.sum("tool_calls"), F.lit(0)).cast("bigint").alias("b_calls"))))
    s = totals(signals).select(F.col("avg_tokens").alias("s_tokens"), F.col("avg_correctness").alias("s_ok"), "top3_hit_rate").crossJoin(F.broadcast(signals.agg(F.count("*").alias("s_calls"))))
    one = b.crossJoin(F.broadcast(s)).withColumn("raw", raw_chars).withColumn("kept", n_signals * 50)
    c, d = F.col, lambda x: x.cast("double")
    even = E.break_even(c("b_chars"), c("b_tokens") - c("s_tokens"))

    def row(name, before, after, reduction, success):
        return F.struct(F.lit(name).alias("metric"), d(before).alias("baseline"), d(after).alias("signals"), d(reduction).alias("reduction"), success.alias("success"))

    rows = F.array(
        row("storage_reduction", c("raw"), c("kept"), E.reduction(c("raw"), c("kept")), c("kept") < c("raw")),
        row("query_context", c("b_tokens"), c("s_tokens"), E.reduction(c("b_tokens"), c("s_tokens")), E.reduction(c("b_tokens"), c("s_tokens")) >= 20),
        row("tool_calls", c("b_calls"), c("s_calls"), E.reduction(c("b_calls"), c("s_calls")), E.reduction(c("b_calls"), c("s_calls")) > 0),
        row("accuracy", c("b_ok"), c("s_ok"), F.lit(0), c("s_ok") >= c("b_ok") - 0.3),
        row("top3_hit_rate", F.lit(0), c("top3_hit_rate"), c("top3_hit_rate"), c("top3_hit_rate") >= 70),
        row("break_even", F.lit(0), even, F.lit(0), even < 50),
    )
    return one.select(F.explode(rows).alias("m")).select("m.*")


def validate_ground_truth(queries: DataFrame) -> DataFrame:
    """(id, error) of rows of (id, query, category, expected): what is missing."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    found = F.array_compact(
        F.array(F.when(blank(F.col("id")), "missing id"), F.when(blank(F.col("query")), "missing query"), F.when(blank(F.col("category")), "missing category"), F.when(F.col("expected").isNull(), "missing expected").when(blank(F.col("expected.kind")), "missing expected kind"))
    )
    return queries.select("id", F.explode(found).alias("error"))


def report_markdown(title: str, metrics: DataFrame) -> str:
    """A report of (metric, ..., success) rows; their number is fixed, so they are collected."""
    rows = metrics.collect()
    names = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(("PASS" if v else "FAIL") if isinstance(v, bool) else str(v) for v in r) + " |" for r in rows]
    missed = [r["metric"] for r in rows if not r["success"]]
    return "\n".join([*lines, "", "Verdict: " + ("FAILED: " + ", ".join(missed) if missed else "PASSED")])


# What a report advises where a metric is missed.
ADVICE = {
    "storage_reduction": "shorten signal texts or leave out kinds that no query asks for",
    "query_context": "return fewer or shorter results a query",
    "tool_calls": "answer from one search instead of several reads",
    "accuracy": "look at the queries with correctness 0 and the kinds they expect",
    "top3_hit_rate": "raise the weight of names and routes, or add tags",
    "break_even": "index less often, or only what changed",
}


def recommendations(metrics: DataFrame) -> DataFrame:
    """(metric, advice) of the metrics that are missed."""
    known = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return metrics.filter("not success").select("metric", F.coalesce(F.element_at(known, F.col("metric")), F.lit("look at the queries behind it")).alias("advice"))


def simulated_signals(queries: DataFrame, seed: int = 0) -> DataFrame:
    """Searching with noise, as the simulated mode has it: one call, a few hundred characters, correctness 2 or 3; seeded."""
    chars = E.half_up(200 + 400 * _noise(seed, "chars"))
    return queries.select("id", (F.lit(1) + F.floor(_noise(seed, "found") * 3)).cast("bigint").alias("count"), chars.alias("chars_read"), E.token_estimate(chars).alias("tokens"), E.decimals(2.0 + _noise(seed, "match")).alias("correctness"))


def benchmark_suite(queries: DataFrame, signals: DataFrame, files: DataFrame, mode: str = "agent") -> tuple[DataFrame, str]:
    """Baseline, signals, metrics and the report for one tree; mode: agent, real or simulated."""
    size = files.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), F.count("*").alias("files")).first()
    if mode == "simulated":
        baseline, found = simulated_baseline(queries, size["files"], size["chars"]), simulated_signals(queries)
    elif mode == "real":
        baseline, found = real_baseline(queries, files), real_signals(queries, signals)
    else:
        baseline, found = agent_baseline(queries, files), signal_benchmark(queries, signals)
    metrics = comparison(baseline, found, F.lit(size["chars"]), F.lit(signals.count()))
    advice = [f"- {r['metric']}: {r['advice']}" for r in recommendations(metrics).collect()]
    return metrics, "\n".join([report_markdown("Comparison", metrics), *(["", "Recommendations:", *advice] if advice else [])])


def navigation_benchmark(spark: SparkSession, search, name: str = "navigation") -> DataFrame:
    """(id, correct) of a fixed query set; search answers (qid, query) with (qid, rank, kind, route, file)."""
    queries = query_set(spark, name)
    return top1_accuracy(queries, search(queries.select(F.col("id").alias("qid"), "query")))


def load_result(spark: SparkSession, path: str) -> DataFrame:
    """Metrics that were saved as JSON."""
    from ..sources.files import read_json

    return read_json(spark, path, "metric string, baseline double, signals double, reduction double, success boolean")


def detailed_metrics(rows: DataFrame, dimensions: tuple[str, ...], score: str | None = None) -> DataFrame:
    """(dimension, value, n[, avg_score]) of results; the mean of a score to 2 places where there is one."""
    if score is None:
        return stats.counts_by(rows, dimensions)
    one = lambda d: rows.filter(F.col(d).isNotNull()).groupBy(F.col(d).alias("value")).agg(F.count("*").alias("n"), E.decimals(F.avg(score)).alias("avg_score")).withColumn("dimension", F.lit(d))
    out = one(dimensions[0])
    for d in dimensions[1:]:
        out = out.unionByName(one(d))
    return out.select("dimension", "value", "n", "avg_score")
