"""Registered queries over the test tables, and the SQL that says the same.

The tables hold no source code, so adapter views stand for it: `sig` (signals from part), `src` (synthetic sources from
part), `log` (a search log from events), `old` and `new` (file snapshots from documents).  They are written in both engines'
SQL.  Where an extractor is checked, the SQL derives the expected signals from the columns, not by patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as E
from .functions import rules
from .operators import code, lines, merge, retrieval, stats, syntax
from .plans import evaluate
from .schema import Bm25, Scoring, Search
from .sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = "WITH " + VIEWS + ("," + sql.strip()[4:] if sql.strip()[:4].upper() == "WITH" else "\n" + sql)
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- adapter views, Spark and DuckDB

_SIG = """SELECT CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS INT) AS key,
  CASE p_size % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'route' WHEN 3 THEN 'import' WHEN 4 THEN 'interface' ELSE 'type' END AS kind,
  p_name AS name,
  concat('catalog/', lower(replace(p_brand, '#', '-')), '/part', CAST(p_partkey % 500 AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' ELSE '.py' END) AS file,
  concat(p_name, ' ', lower(p_type), ' ', p_brand) AS text,
  CASE WHEN p_size % 3 = 0 THEN 'express' WHEN p_size % 7 = 0 THEN 'react' END AS framework,
  CASE WHEN p_size % 5 = 0 THEN 'javascript' ELSE 'typescript' END AS language,
  CASE WHEN p_size % 6 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END END AS method,
  CASE WHEN p_size % 6 = 2 THEN concat('/', lower(replace(p_name, ' ', '/'))) END AS path,
  CAST(p_partkey % 90 + 1 AS INT) AS line_start, p_size, p_brand FROM part"""
_SRC = """SELECT CAST(p_partkey AS INT) AS key, concat('src/', lower(replace(p_brand, '#', '')), '/f', CAST(p_partkey AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.tsx' WHEN 1 THEN '.ts' ELSE '.js' END) AS file,
  concat('fn', CAST(p_partkey AS STRING)) AS fn, concat('arrow', CAST(p_partkey AS STRING)) AS arrow, concat('Cls', CAST(p_size AS STRING)) AS cls, concat('IShape', CAST(p_size AS STRING)) AS shape,
  lower(replace(p_name, ' ', '-')) AS module, CASE WHEN p_size % 2 = 0 THEN 'get' ELSE 'post' END AS verb, concat('/', lower(replace(p_name, ' ', '/'))) AS path, p_size, p_partkey FROM part"""
_LOG = "SELECT event_id, event_type AS query, CAST(floor(value / 10) AS INT) AS results_count, ts, value FROM events"
_OLD = "SELECT concat('f', CAST(doc_id AS STRING)) AS path, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS mtime, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE CAST(n_chars AS STRING) END AS hash FROM documents WHERE doc_id % 5 <> 0"
_NEW = "SELECT concat('f', CAST(doc_id AS STRING)) AS path, 2 AS mtime, CAST(n_chars AS STRING) AS hash FROM documents WHERE doc_id % 7 <> 0"


def _duck(sql: str) -> str:
    return sql.replace(" AS STRING)", " AS VARCHAR)")


VIEWS = f"sig AS ({_duck(_SIG)}), src AS ({_duck(_SRC)}), log AS ({_LOG}), old AS ({_duck(_OLD)}), new AS ({_duck(_NEW)})"


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.rsplit(f"FROM {table}", 1)[0] + "FROM {base}" + sql.rsplit(f"FROM {table}", 1)[1], base=t(spark, sf_dir, table))


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "part", _SIG)
    route = F.when(F.col("method").isNotNull(), F.struct("method", "path", F.lit(None).cast("string").alias("handler")))
    return rows.withColumn("route", route).withColumn("tags", F.array("kind", "p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string"))))


def src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic sources: one file for each part."""
    rows = _view(spark, sf_dir, "part", _SRC)
    content = F.concat(
        F.lit("import { helper } from '"), "module", F.lit("'\n\nexport async function "), "fn", F.lit("(a, b) {\n  return helper(a, b)\n}\n\nconst "), "arrow", F.lit(" = (x) => x\n\nexport class "), "cls", F.lit(" {\n}\n\nexport interface "), "shape",
        F.lit(" {\n  size: number\n}\n\napp."), "verb", F.lit("('"), "path", F.lit("', "), "arrow", F.lit(")\n"),
    )
    return rows.withColumn("content", content)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", _LOG)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _view(spark, sf_dir, "documents", _OLD), _view(spark, sf_dir, "documents", _NEW)


def outputs(frame: DataFrame, tool: str, output) -> DataFrame:
    return frame.select(F.col("key").cast("string").alias("id"), F.lit("s").alias("session_id"), F.lit(tool).alias("tool"), F.lit("").alias("input"), output.alias("output"), F.lit(None).cast("timestamp").alias("created_at"))


# ---- scans and predicates

_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages as file paths, some in folders that scans leave out."""
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("p"))
    return p.withColumn("path", F.concat(F.when(F.col("page_id") % 5 == 0, "dist").when(F.col("page_id") % 7 == 0, ".hidden").otherwise("src"), F.regexp_replace("p", "/$", ""), F.when(F.col("page_id") % 3 == 0, ".ts").when(F.col("page_id") % 3 == 1, ".py").otherwise("")))


_PAGE_PATHS = """pp AS (SELECT page_id, concat(CASE WHEN page_id % 5 = 0 THEN 'dist' WHEN page_id % 7 = 0 THEN '.hidden' ELSE 'src' END, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', ''),
  CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '' END) AS path FROM pages)"""


@query("scan_filter_ext_ignore", f"WITH {_PAGE_PATHS} SELECT page_id, path FROM pp WHERE page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 3 < 2")
def _(spark, sf):
    return page_paths(spark, sf).filter(S.supported("path")).select("page_id", "path")


@query("corpus_size", "SELECT CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) AS total_files FROM documents")
def _(spark, sf):
    return S.corpus_size(t(spark, sf, "documents"), "text")


@query("head_chars", "SELECT doc_id, CAST(length(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS BIGINT) AS head FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.head_chars("text", 3).alias("head"))


def _head_chars(n: int) -> None:
    @query(f"head_chars_{n}", f"SELECT doc_id, CAST(length(array_to_string(string_split(text, chr(10))[1:{n}], chr(10))) AS BIGINT) AS head FROM documents")
    def _(spark, sf):
        return t(spark, sf, "documents").select("doc_id", S.head_chars("text", n).alias("head"))


# The lines that the reference reads.
_head_chars(50)
_head_chars(100)


@query("lookup_by_id", "SELECT id, kind, name FROM sig WHERE id = '17'")
def _(spark, sf):
    return sig(spark, sf).filter("id = '17'").select("id", "kind", "name").limit(1)


@query("filter_kind", "SELECT id, kind, file FROM sig WHERE kind = 'route'")
def _(spark, sf):
    return sig(spark, sf).filter("kind = 'route'").select("id", "kind", "file")


@query("filter_file", "SELECT id, file FROM sig WHERE file = 'catalog/brand-7/part12.ts'")
def _(spark, sf):
    return sig(spark, sf).filter("file = 'catalog/brand-7/part12.ts'").select("id", "file")


@query("filter_framework", "SELECT id, framework FROM sig WHERE framework = 'react'")
def _(spark, sf):
    return sig(spark, sf).filter("framework = 'react'").select("id", "framework")


@query("remove_by_file", "SELECT id FROM sig WHERE file <> 'catalog/brand-7/part12.ts' OR file IS NULL")
def _(spark, sf):
    return merge.remove_by_file(sig(spark, sf), "catalog/brand-7/part12.ts").select("id")


@query("post_filter", "SELECT id FROM sig WHERE kind = 'class' AND contains(lower(file), 'brand-1')")
def _(spark, sf):
    return retrieval.post_filter(sig(spark, sf), kind="class", file="BRAND-1").select("id")


@query(
    "kind_catalog",
    """SELECT * FROM (VALUES (0, 'file'), (1, 'import'), (2, 'export'), (3, 'function'), (4, 'class'), (5, 'interface'), (6, 'type'), (7, 'component'), (8, 'route'), (9, 'middleware'), (10, 'symbol'), (11, 'diagnostic')) k(position, kind)""",
)
def _(spark, sf):
    from .schema import KINDS

    return spark.createDataFrame([(i, k) for i, k in enumerate(KINDS)], "position int, kind string")


_LANG = "CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.ts' THEN '{}' WHEN '.py' THEN '{}' WHEN '.html' THEN '{}' ELSE '{}' END"


@query(
    "language_detect",
    f"""WITH {_PAGE_PATHS} SELECT page_id, {_LANG.format("typescript", "python", "unknown", "unknown")} AS v1, 'typescript' AS v2, {_LANG.format("typescript", "javascript", "javascript", "javascript")} AS fallback FROM pp""",
)
def _(spark, sf):
    return page_paths(spark, sf).select("page_id", E.language("path").alias("v1"), E.source_language("path").alias("v2"), E.fallback_language("path").alias("fallback"))


@query("builtin_exclusion", "SELECT key, CASE p_size % 4 WHEN 0 THEN 'console' WHEN 1 THEN 'len' ELSE name END AS n FROM sig WHERE p_size % 4 > 1")
def _(spark, sf):
    named = F.when(F.col("p_size") % 4 == 0, "console").when(F.col("p_size") % 4 == 1, "len").otherwise(F.col("name"))
    return sig(spark, sf).withColumn("n", named).filter(~F.col("n").isin(*rules.BUILTINS)).select("key", "n")


@query("component_name", "SELECT key, CASE p_size % 4 WHEN 0 THEN 'Widget' WHEN 1 THEN 'useThing' WHEN 2 THEN 'JSON' ELSE name END = 'Widget' AS ok FROM sig")
def _(spark, sf):
    named = F.when(F.col("p_size") % 4 == 0, "Widget").when(F.col("p_size") % 4 == 1, "useThing").when(F.col("p_size") % 4 == 2, "JSON").otherwise(F.col("name"))
    return sig(spark, sf).select("key", E.is_component(named).alias("ok"))


@query("http_method", "SELECT key, coalesce(method, kind) IN ('GET', 'POST') OR kind = 'route' AS ok FROM sig")
def _(spark, sf):
    return sig(spark, sf).select("key", E.is_http_method(F.coalesce("method", "kind"), ("route",)).alias("ok"))


@query("framework_detect", "SELECT key, 'express' || CASE WHEN p_size < 0 THEN ',react' ELSE '' END AS frameworks FROM src")
def _(spark, sf):
    return src(spark, sf).select("key", F.array_join(E.frameworks(F.col("content"), F.col("file")), ",").alias("frameworks"))


@query("content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


# ---- change plans, merges, dedup

_PLAN = """WITH plan AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'new' WHEN n.mtime = o.mtime OR n.hash = o.hash THEN 'unchanged' ELSE 'changed' END AS status
FROM new n FULL OUTER JOIN old o ON n.path = o.path)"""


@query("incremental_plan", _PLAN + " SELECT path, status FROM plan")
def _(spark, sf):
    o, n = snapshots(spark, sf)
    return merge.incremental_plan(n, o)


@query("incremental_removed", "SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def _(spark, sf):
    o, n = snapshots(spark, sf)
    return merge.removed(n, o)


@query("incremental_force", "SELECT path, CASE WHEN path IN (SELECT path FROM old) THEN 'changed' ELSE 'new' END AS status FROM new")
def _(spark, sf):
    o, n = snapshots(spark, sf)
    return merge.incremental_plan(n, o, force=True)


@query(
    "scan_counters",
    _PLAN
    + """ SELECT count(*) FILTER (WHERE status <> 'removed') AS scanned, count(*) FILTER (WHERE status IN ('new', 'changed')) AS to_index, count(*) FILTER (WHERE status = 'unchanged') AS up_to_date, count(*) FILTER (WHERE status = 'removed') AS removed FROM plan""",
)
def _(spark, sf):
    o, n = snapshots(spark, sf)
    return merge.scan_counters(merge.incremental_plan(n, o))


@query("meta_upsert", "SELECT path, mtime, hash FROM new UNION ALL SELECT path, mtime, hash FROM old WHERE path NOT IN (SELECT path FROM new)")
def _(spark, sf):
    o, n = snapshots(spark, sf)
    return merge.upsert(o, n, "path")


@query("partial_update", "SELECT o.path, coalesce(n.mtime, o.mtime) AS mtime, coalesce(CASE WHEN n.mtime = 2 AND length(n.hash) > 3 THEN n.hash END, o.hash) AS hash FROM old o LEFT JOIN new n ON o.path = n.path")
def _(spark, sf):
    o, n = snapshots(spark, sf)
    return merge.partial_update(o, n.withColumn("hash", F.when(F.length("hash") > 3, F.col("hash"))), "path")


def shifted(spark, sf) -> DataFrame:
    """sig and, of every second one, a copy with other text and a later place."""
    rows = sig(spark, sf).withColumn("pos", F.col("key"))
    return rows.unionByName(rows.filter("key % 2 = 0").withColumn("text", F.upper("text")).withColumn("pos", F.col("pos") + 1000000))


_SHIFTED = "both_ AS (SELECT *, key AS pos FROM sig UNION ALL SELECT * REPLACE (upper(text) AS text), key + 1000000 AS pos FROM sig WHERE key % 2 = 0)"
_KEY = "CASE WHEN kind = 'route' THEN concat_ws('|', kind, file, method, path) ELSE concat_ws('|', kind, file, coalesce(name, ''), CAST(line_start AS VARCHAR)) END"


@query("dedup_key_v2", f"WITH {_SHIFTED}, r AS (SELECT id, text, row_number() OVER (PARTITION BY {_KEY} ORDER BY pos) AS rn FROM both_) SELECT id, text FROM r WHERE rn = 1")
def _(spark, sf):
    return merge.first_wins(shifted(spark, sf), [E.signal_key().alias("k")], ["pos"]).select("id", "text")


@query("dedup_key_v1", f"WITH {_SHIFTED}, r AS (SELECT id, text, row_number() OVER (PARTITION BY kind, file, name, line_start, text ORDER BY pos) AS rn FROM both_) SELECT id, text FROM r WHERE rn = 1")
def _(spark, sf):
    return merge.first_wins(shifted(spark, sf), [E.line_key().alias("k")], ["pos"]).select("id", "text")


@query("merge_insert_only", f"WITH e AS (SELECT {_KEY} AS k FROM sig WHERE key % 3 = 0), r AS (SELECT id, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY key) AS rn FROM sig) SELECT id FROM r WHERE rn = 1 AND k NOT IN (SELECT k FROM e)")
def _(spark, sf):
    rows = sig(spark, sf)
    return merge.merge_insert_only(rows.filter("key % 3 = 0"), rows, E.signal_key(), ["key"]).select("id")


@query("merge_stats", f"WITH e AS (SELECT DISTINCT {_KEY} AS k FROM sig WHERE key % 3 = 0), n AS (SELECT {_KEY} AS k FROM sig), c AS (SELECT count(DISTINCT k) AS created FROM n WHERE k NOT IN (SELECT k FROM e)) SELECT created, (SELECT count(*) FROM n) - created AS updated FROM c")
def _(spark, sf):
    rows = sig(spark, sf)
    return merge.merge_counts(rows.filter("key % 3 = 0"), rows, E.signal_key())


@query(
    "union_extractors",
    """SELECT file, 'function' AS kind, fn AS name, 3 AS line_start FROM src UNION ALL SELECT file, 'function', arrow, 7 FROM src UNION ALL SELECT file, 'class', cls, 9 FROM src
UNION ALL SELECT file, 'route', upper(verb) || ' ' || path, 16 FROM src""",
)
def _(spark, sf):
    """Declarations by structure and routes by pattern, as one relation."""
    files = src(spark, sf).select("file", "content")
    columns = ["file", "kind", "name", "line_start"]
    declared = syntax.structural_signals(files, routes=False).filter("kind in ('function', 'class')").select(*columns)
    return declared.unionByName(code.express_routes(files).select(*columns))


# ---- statistics


@query("stats_by_kind_lang_fw", "SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM sig GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM sig GROUP BY 2 UNION ALL SELECT 'framework', framework, count(*) FROM sig WHERE framework IS NOT NULL GROUP BY 2")
def _(spark, sf):
    return stats.counts_by(sig(spark, sf))


@query("stats_grouping_sets", "SELECT kind, language, framework, CAST(grouping_id(kind, language, framework) AS INT) AS gid, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM sig GROUP BY GROUPING SETS ((kind), (language), (framework), ())")
def _(spark, sf):
    return stats.grouping_sets(sig(spark, sf))


@query("storage_reduction", "SELECT count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS signal_chars, CAST(1000000 AS BIGINT) AS raw_source_chars, CAST(floor((1000000 - sum(length(text))) / 1000000 * 100 + 0.5) AS BIGINT) AS reduction_percent FROM sig")
def _(spark, sf):
    return stats.storage(sig(spark, sf), 1_000_000)


@query("detailed_metrics", "SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM sig GROUP BY 2 UNION ALL SELECT 'framework', framework, count(*) FROM sig WHERE framework IS NOT NULL GROUP BY 2")
def _(spark, sf):
    return evaluate.detailed_metrics(sig(spark, sf), ("kind", "framework"))


_STATS = """s AS (SELECT count(*) AS total_searches, floor(sum(results_count) / count(*) * 10 + 0.5) / 10.0 AS avg_results,
  (SELECT CAST(floor(count(*) FILTER (WHERE results_count >= 3) / 3 * 100 + 0.5) AS BIGINT) FROM (SELECT results_count FROM log ORDER BY ts DESC, event_id DESC LIMIT 3)) AS top3_hit_rate,
  count(*) FILTER (WHERE results_count = 0) AS zero_result_queries FROM log)"""


@query("search_log_stats", f"WITH {_STATS} SELECT * FROM s")
def _(spark, sf):
    return stats.search_stats(log(spark, sf), "ts", "event_id")


@query("search_log_tail", "SELECT event_id, query, results_count FROM log ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(spark, sf):
    return stats.last_rows(log(spark, sf), 10, "ts", "event_id").select("event_id", "query", "results_count")


@query("search_log_trim", "SELECT event_id FROM log ORDER BY ts DESC, event_id DESC LIMIT (SELECT CASE WHEN count(*) > 1000 THEN 500 ELSE 1000 END FROM log)")
def _(spark, sf):
    return stats.trimmed(log(spark, sf), "ts", "event_id").select("event_id")


@query(
    "status_bucket",
    """SELECT event_id, CASE WHEN value >= 90 THEN 'Exceptional' WHEN value >= 70 THEN 'Strong' WHEN value >= 50 THEN 'Moderate' WHEN value >= 10 THEN 'Minimal' ELSE 'Below Threshold' END AS storage,
  CASE WHEN value >= 80 THEN 'Excellent' WHEN value >= 60 THEN 'Good' WHEN value >= 40 THEN 'Moderate' WHEN value >= 20 THEN 'Poor' ELSE 'Below Threshold' END AS retrieval,
  CASE WHEN value * 20 < 100 THEN 'On Track' WHEN value * 20 < 500 THEN 'Moderate' WHEN value * 20 < 1000 THEN 'Extended' ELSE 'At Risk' END AS break_even FROM log""",
)
def _(spark, sf):
    v = F.col("value")
    return log(spark, sf).select("event_id", E.storage_status(v).alias("storage"), E.retrieval_status(v).alias("retrieval"), E.break_even_status(v * 20).alias("break_even"))


@query(
    "relative_age",
    """WITH a AS (SELECT event_id, epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(ts) AS s FROM log), b AS (SELECT event_id, CAST(floor(s / 60) AS BIGINT) AS m, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor(s / 86400) AS BIGINT) AS d FROM a)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago' WHEN h < 24 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' ELSE d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM b""",
)
def _(spark, sf):
    return log(spark, sf).select("event_id", E.ago(F.col("ts"), F.expr("timestamp'2024-03-01 00:00:00'")).alias("age"))


def runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders as two runs of queries: even ones read files, odd ones search signals."""
    o = t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("tokens"), (F.col("o_orderkey") % 4).alias("full_reads"), (F.col("o_orderkey") % 5 + 1).alias("tool_calls"), (F.col("o_custkey") % 4).alias("correctness"), (F.col("o_custkey") % 4 >= 2).alias("top3_hit")
    )
    return o.filter("k % 2 = 0"), o.filter("k % 2 = 1").withColumn("tokens", F.floor(F.col("tokens") / 4).cast("bigint"))


_RUNS = """o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) AS tk, o_orderkey % 4 AS fr, o_orderkey % 5 + 1 AS tc, o_custkey % 4 AS co FROM orders),
b AS (SELECT floor(sum(tk) / count(*) + 0.5) AS bt, sum(fr) AS br, sum(tc) AS bc, floor(sum(co) / count(*) * 100 + 0.5) / 100 AS ba FROM o WHERE k % 2 = 0),
g AS (SELECT floor(sum(floor(tk / 4)) / count(*) + 0.5) AS st, sum(fr) AS sr, sum(tc) AS sc, floor(sum(co) / count(*) * 100 + 0.5) / 100 AS sa, floor(count(*) FILTER (WHERE co >= 2) * 100 / count(*) * 10 + 0.5) / 10 AS hit FROM o WHERE k % 2 = 1),
m AS (SELECT *, bt - st AS sv, floor((800000 - 120000) / 800000 * 100 + 0.5) AS r0, floor((bt - st) / bt * 100 + 0.5) AS r1, floor((br - sr) / br * 100 + 0.5) AS r2, floor((bc - sc) / bc * 100 + 0.5) AS r3, CASE WHEN bt > st THEN ceil(800000 / (bt - st)) ELSE 999 END AS ev FROM b, g)"""
_METRIC = """SELECT 'storage' AS metric, 800000::DOUBLE AS before, 120000::DOUBLE AS after, r0::DOUBLE AS reduction, true AS success FROM m
UNION ALL SELECT 'query_context', bt::DOUBLE, st::DOUBLE, r1::DOUBLE, r1 >= 20 FROM m
{} UNION ALL SELECT 'tool_calls', bc::DOUBLE, sc::DOUBLE, r3::DOUBLE, r3 > 0 FROM m
UNION ALL SELECT 'accuracy', ba::DOUBLE, sa::DOUBLE, 0::DOUBLE, sa >= ba - 0.3::DOUBLE FROM m
UNION ALL SELECT 'retrieval', 0::DOUBLE, hit::DOUBLE, hit::DOUBLE, hit >= 70 FROM m
UNION ALL SELECT 'break_even', sv::DOUBLE, ev::DOUBLE, 0::DOUBLE, sv > 0 AND ev < 50 FROM m"""


@query("full_metrics", f"WITH {_RUNS} " + _METRIC.format("UNION ALL SELECT 'full_file_reads', br::DOUBLE, sr::DOUBLE, r2::DOUBLE, r2 > 0 FROM m"))
def _(spark, sf):
    b, s = runs(spark, sf)
    return stats.full_metrics(b, s, F.lit(800_000), F.lit(120_000))


@query("real_metrics", f"WITH {_RUNS} " + _METRIC.format(""))
def _(spark, sf):
    b, s = runs(spark, sf)
    return stats.full_metrics(b, s, F.lit(800_000), F.lit(120_000), full_reads=False)


@query("break_even", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice > 200000 THEN ceil(12000000 / (o_totalprice - 200000)) ELSE 999 END AS BIGINT) AS even FROM orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", E.break_even(F.lit(12_000_000), F.col("o_totalprice") - 200_000).alias("even"))


@query("runner_accuracy", "WITH r AS (SELECT event_id AS position, results_count >= 3 AS ok FROM log), a AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok AND position < 3) AS first3, count(*) FILTER (WHERE ok AND position < 5) AS first5 FROM r) SELECT total, correct, CAST(floor(correct / total * 100 + 0.5) AS BIGINT) AS accuracy_percent, correct / total >= 0.7 AS accuracy_ok, first3, first5, first3 / total >= 0.6 OR first5 / total >= 0.8 AS retrieval_ok FROM a")
def _(spark, sf):
    return stats.runner_accuracy(log(spark, sf).select(F.col("event_id").alias("position"), (F.col("results_count") >= 3).alias("correct")))


@query(
    "mode_metrics",
    """WITH q AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'signals' ELSE 'baseline' END AS mode, results_count * CASE WHEN event_id % 3 = 0 THEN 1 ELSE 10 END AS chars FROM log),
a AS (SELECT count(*) AS total_queries, count(*) FILTER (WHERE mode = 'signals') AS signal_queries, count(*) FILTER (WHERE mode = 'baseline') AS baseline_queries, CAST(sum(chars) FILTER (WHERE mode = 'signals') AS BIGINT) AS signal_chars, CAST(sum(chars) FILTER (WHERE mode = 'baseline') AS BIGINT) AS baseline_chars FROM q),
b AS (SELECT *, CAST(floor(signal_chars / signal_queries + 0.5) AS BIGINT) AS avg_signal_chars, CAST(floor(baseline_chars / baseline_queries + 0.5) AS BIGINT) AS avg_baseline_chars, CAST(floor((baseline_chars - signal_chars) / baseline_chars * 100 + 0.5) AS BIGINT) AS reduction_percent FROM a)
SELECT *, CAST(CASE WHEN avg_baseline_chars > avg_signal_chars THEN ceil(12000 / (avg_baseline_chars - avg_signal_chars)) ELSE 0 END AS BIGINT) AS break_even FROM b""",
)
def _(spark, sf):
    third = F.col("event_id") % 3 == 0
    return stats.mode_metrics(log(spark, sf).select(F.when(third, "signals").otherwise("baseline").alias("mode"), (F.col("results_count") * F.when(third, 1).otherwise(10)).alias("chars")))


@query(
    "tool_stats",
    f"""WITH {_STATS}, i AS (SELECT count(*) AS total_files, CAST(sum(n_chars) AS BIGINT) AS raw_source_chars FROM documents), g AS (SELECT count(*) AS total_signals, CAST(sum(length(text)) AS BIGINT) AS signal_chars FROM sig),
a AS (SELECT *, CAST(floor((raw_source_chars - signal_chars) / raw_source_chars * 100 + 0.5) AS BIGINT) AS reduction_percent, CAST(floor(raw_source_chars / total_searches + 0.5) AS BIGINT) AS avg_savings FROM g, i, s),
b AS (SELECT *, CASE WHEN avg_savings > 0 THEN CAST(floor(raw_source_chars / avg_savings + 0.5) AS BIGINT) ELSE 0 END AS break_even, CAST(floor(raw_source_chars / total_files + 0.5) AS BIGINT) AS per_query_before, CAST(floor(signal_chars / total_files + 0.5) AS BIGINT) AS per_query_after FROM a)
SELECT *, CAST(floor((per_query_before - per_query_after) / per_query_before * 100 + 0.5) AS BIGINT) AS token_savings_percent,
  CASE WHEN reduction_percent >= 90 THEN 'Exceptional' WHEN reduction_percent >= 70 THEN 'Strong' WHEN reduction_percent >= 50 THEN 'Moderate' WHEN reduction_percent >= 10 THEN 'Minimal' ELSE 'Below Threshold' END AS storage_status,
  CASE WHEN top3_hit_rate >= 80 THEN 'Excellent' WHEN top3_hit_rate >= 60 THEN 'Good' WHEN top3_hit_rate >= 40 THEN 'Moderate' WHEN top3_hit_rate >= 20 THEN 'Poor' ELSE 'Below Threshold' END AS retrieval_status,
  CASE WHEN break_even < 100 THEN 'On Track' WHEN break_even < 500 THEN 'Moderate' WHEN break_even < 1000 THEN 'Extended' ELSE 'At Risk' END AS break_even_status FROM b""",
)
def _(spark, sf):
    meta = t(spark, sf, "documents").agg(F.count("*").alias("total_files"), F.sum("n_chars").alias("raw_source_chars"))
    return stats.tool_stats(sig(spark, sf), meta, log(spark, sf), "ts", "event_id")


@query("mock_indexing", "SELECT CAST(sum(length(text)) AS BIGINT) AS raw_source_chars, count(*) AS files, CAST(floor(sum(length(text)) * 0.15::DOUBLE + 0.5) AS BIGINT) AS signal_chars, CAST(floor((sum(length(text)) - floor(sum(length(text)) * 0.15::DOUBLE + 0.5)) / sum(length(text)) * 100 + 0.5) AS BIGINT) AS reduction_percent FROM documents")
def _(spark, sf):
    return stats.mock_indexing(t(spark, sf, "documents"), "text")


@query(
    "mock_counts",
    """WITH f AS (SELECT count(*) AS files FROM documents)
SELECT dimension, value, CAST(floor(files * x + 0.5) AS BIGINT) AS n FROM f, (VALUES ('kind', 'function', 3.0::DOUBLE), ('kind', 'class', 0.8), ('kind', 'route', 2.0),
  ('kind', 'import', 4.0), ('kind', 'middleware', 0.5), ('language', 'typescript', 10.0), ('language', 'javascript', 0.0), ('framework', 'express', 2.0)) AS m(dimension, value, x)""",
)
def _(spark, sf):
    return stats.mock_counts(t(spark, sf, "documents"))


@query("compact_size", """SELECT CAST(sum(length(text)) AS BIGINT) AS text_chars, CAST(sum(length(kind) + length(name) + length(file) + length(text) + length('{"kind":"","name":"","file":"","text":""}')) AS BIGINT) AS json_chars, CAST(sum(length(kind) + 1 + length(name)) + count(*) - 1 AS BIGINT) AS compact_chars FROM sig""")
def _(spark, sf):
    return stats.compact_sizes(sig(spark, sf))


# ---- tool output


def read_outputs(spark, sf) -> DataFrame:
    rows = src(spark, sf)
    body = F.array_join(F.transform(F.split("content", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    return outputs(rows, "read", F.concat(F.lit("<path>"), "file", F.lit("</path>\n<content>\n"), body, F.lit("\n</content>")))


@query("read_output_lines", "SELECT CAST(key AS VARCHAR) AS id, file, count(*) AS n, CAST(max(line_no) AS INT) AS last FROM (SELECT key, file, unnest([1, 3, 4, 5, 7, 9, 10, 12, 13, 14, 16]) AS line_no FROM src) GROUP BY key, file")
def _(spark, sf):
    return lines.read_lines(read_outputs(spark, sf)).groupBy("id", "file").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))


_READ_SQL = """SELECT CAST(key AS VARCHAR) AS evidence_id, 'class' AS kind, cls AS name, 9 AS line_start, 0.9::DOUBLE AS confidence FROM src
UNION ALL SELECT CAST(key AS VARCHAR), 'class', shape, 12, 0.9::DOUBLE FROM src UNION ALL SELECT CAST(key AS VARCHAR), 'function', arrow, 7, 0.9::DOUBLE FROM src
UNION ALL SELECT CAST(key AS VARCHAR), 'route', upper(verb) || ' ' || path, 16, 0.95::DOUBLE FROM src UNION ALL SELECT CAST(key AS VARCHAR), 'import', NULL, 1, 0.85::DOUBLE FROM src UNION ALL SELECT CAST(key AS VARCHAR), 'file_read', NULL, NULL, 1.0::DOUBLE FROM src"""


@query("read_signals", _READ_SQL)
def _(spark, sf):
    return lines.read_signals(read_outputs(spark, sf)).select("evidence_id", "kind", "name", "line_start", "confidence")


@query("tag_builder", "SELECT CAST(key AS VARCHAR) AS evidence_id, concat_ws(',', 'file', 'read', CASE WHEN file LIKE '%.js' THEN 'javascript' ELSE 'typescript' END, string_split(file, '/')[-1], string_split(file, '.')[-1]) AS tags FROM src")
def _(spark, sf):
    return lines.read_signals(read_outputs(spark, sf)).filter("kind = 'file_read'").select("evidence_id", F.array_join("tags", ",").alias("tags"))


@query("grep_matches", "SELECT CAST(key AS VARCHAR) AS evidence_id, '/repo/' || file AS file, CAST(p_size AS INT) AS line_start, 'Search match in /repo/' || file || ' at line ' || p_size || ': ' || fn || '()' AS text FROM src")
def _(spark, sf):
    text = F.concat(F.lit("Found 1\n  Line 1: lost\n/repo/"), "file", F.lit(":\n  Line "), F.col("p_size").cast("string"), F.lit(": "), "fn", F.lit("()\n"))
    return lines.grep_signals(outputs(src(spark, sf), "grep", text)).select("evidence_id", "file", "line_start", "text")


@query("glob_paths", "SELECT CAST(key AS VARCHAR) AS evidence_id, file, 'Discovered file ' || file AS text FROM src UNION ALL SELECT CAST(key AS VARCHAR), file, 'Discovered file ' || file FROM src")
def _(spark, sf):
    text = F.concat(F.lit("Found 2 files\n"), "file", F.lit("\n\n  "), "file", F.lit("  \nplain\n"))
    return lines.glob_signals(outputs(src(spark, sf), "glob", text)).select("evidence_id", "file", "text")


@query("bash_classify", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(substr(text, 1, 4000)), 'error|failed|exception|traceback|cannot find|not recognized') THEN 'error' ELSE 'command_output' END AS kind FROM conversations")
def _(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", lines.bash_kind(F.col("text")).alias("kind"))


_LSP_KIND = "CASE WHEN p_size % 16 IN (5, 9, 10, 11) THEN 'class' WHEN p_size % 16 = 1 THEN 'file_path' ELSE 'function' END"


@query("lsp_flat", f"SELECT CAST(key AS VARCHAR) AS evidence_id, {_LSP_KIND} AS kind, name, '/w/' || file AS file, line_start FROM sig")
def _(spark, sf):
    place = F.struct(F.concat(F.lit("file:///w/"), "file").alias("uri"), F.struct(F.struct(F.col("line_start").alias("line")).alias("start")).alias("range"))
    json = F.to_json(F.array(F.struct("name", (F.col("p_size") % 16).alias("kind"), place.alias("location"))))
    return lines.lsp_signals(outputs(sig(spark, sf), "lsp", json)).select("evidence_id", "kind", "name", "file", "line_start")


@query("lsp_error_fallback", "SELECT CAST(event_id AS VARCHAR) AS evidence_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'lsp_result' END AS kind, event_type || ' ' || props AS text FROM events")
def _(spark, sf):
    rows = t(spark, sf, "events").withColumn("key", F.col("event_id"))
    return lines.lsp_signals(outputs(rows, "lsp", F.concat_ws(" ", "event_type", "props"))).select("evidence_id", "kind", "text")


@query("lsp_symbol_map", "SELECT key, CASE WHEN p_size % 16 IN (5, 9, 10, 11) THEN 'class' WHEN p_size % 16 = 1 THEN 'file_path' WHEN p_size % 16 IN (0, 15) THEN 'symbol' ELSE 'function' END AS kind FROM sig")
def _(spark, sf):
    return sig(spark, sf).select("key", lines.symbol(F.col("p_size") % 16, 0, "symbol").alias("kind"))


@query(
    "lsp_tree",
    """WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn, n_nationkey FROM nation)
SELECT CAST(r_regionkey AS VARCHAR) AS evidence_id, 'class' AS kind, r_name AS name, 'Class ' || r_name AS text, 0 AS line_start, 0 AS emit_pos FROM region
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 'function', n_name, n_name || ': nation', CAST(n_nationkey AS INT), CAST(rn AS INT) FROM n""",
)
def _(spark, sf):
    start = lambda c: F.struct(F.struct(c.cast("int").alias("line")).alias("start"), F.struct(c.cast("int").alias("line")).alias("end"))
    child = F.struct(F.col("n_nationkey").alias("o"), F.col("n_name").alias("name"), F.lit(6).alias("kind"), F.lit("nation").alias("detail"), start(F.col("n_nationkey")).alias("range"))
    children = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(child)).alias("children"))
    rows = t(spark, sf, "region").join(children, F.col("r_regionkey") == F.col("n_regionkey"), "left").withColumn("key", F.col("r_regionkey"))
    json = F.to_json(F.struct(F.array(F.struct(F.col("r_name").alias("name"), F.lit(5).alias("kind"), start(F.lit(0)).alias("range"), "children")).alias("result")))
    return lines.lsp_signals(outputs(rows, "lsp", json)).select("evidence_id", "kind", "name", "text", "line_start", F.col("emit_pos").cast("int").alias("emit_pos"))


# ---- sources


@query(
    "regex_fallback_all",
    """SELECT file, 'import' AS kind, NULL AS name, 'import from ''' || module || '''' AS text, 1 AS line_start FROM src
UNION ALL SELECT file, 'export', NULL, 'export class', 9 FROM src UNION ALL SELECT file, 'function', fn, 'function ' || fn || '(...)', 3 FROM src
UNION ALL SELECT file, 'function', arrow, 'const ' || arrow || ' = (...) => ...', 7 FROM src UNION ALL SELECT file, 'class', cls, 'class ' || cls, 9 FROM src
UNION ALL SELECT file, 'interface', shape, 'interface ' || shape, 12 FROM src UNION ALL SELECT file, 'route', upper(verb) || ' ' || path, upper(verb) || ' ' || path, 16 FROM src""",
)
def _(spark, sf):
    return code.fallback_signals(src(spark, sf).select("file", "content")).select("file", "kind", "name", "text", "line_start")


@query("express_regex", "SELECT file, upper(verb) AS method, path, 16 AS line_start FROM src")
def _(spark, sf):
    return code.express_routes(src(spark, sf).select("file", "content")).select("file", "method", "path", "line_start")


@query("fastify_regex", "SELECT file, upper(verb) AS method, path, 16 AS line_start FROM src")
def _(spark, sf):
    return code.fastify_routes(src(spark, sf).select("file", F.replace("content", F.lit("app."), F.lit("fastify.")).alias("content"))).select("file", "method", "path", "line_start")


@query("next_regex", "SELECT 'web/app/api/p' || key || '/route.ts' AS file, upper(verb) AS method, '/api/p' || key AS path FROM src")
def _(spark, sf):
    file = F.concat(F.lit("web/app/api/p"), F.col("key").cast("string"), F.lit("/route.ts"))
    return code.next_routes(src(spark, sf).select(file.alias("file"), F.concat(F.lit("export async function "), F.upper("verb"), F.lit("(r) {\n}\n")).alias("content"))).select("file", "method", "path")


@query("react_regex", "SELECT file, cls AS name, 2 AS line_start FROM src")
def _(spark, sf):
    return code.react_components(src(spark, sf).select("file", F.concat(F.lit("// view\nexport function "), "cls", F.lit("(props) {\n  return null\n}\n")).alias("content"))).select("file", "name", "line_start")


@query("next_app_path", "SELECT key, '/api/' || module || '/id' AS api FROM src")
def _(spark, sf):
    return src(spark, sf).select("key", E.app_path(F.concat(F.lit("my-app/src/app/api/"), "module", F.lit("/[id]"))).alias("api"))


@query("next_pages_path", "SELECT key, '/api/' || module || CASE WHEN p_size % 2 = 0 THEN '' ELSE '/:id' END AS api FROM src")
def _(spark, sf):
    last = F.when(F.col("p_size") % 2 == 0, "/index.ts").otherwise("/[id].ts")
    return src(spark, sf).select("key", E.pages_path(F.concat(F.lit("web/pages/api/"), "module", last)).alias("api"))


@query("offset_to_line", "SELECT doc_id, CAST(len(string_split(substr(text, 1, n_chars // 2), chr(10))) AS INT) AS line FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", E.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


@query(
    "fixture_extract",
    """SELECT file, 'import' AS kind, module AS name, 1 AS line FROM src UNION ALL SELECT file, 'function', fn, 3 FROM src UNION ALL SELECT file, 'function', arrow, 7 FROM src UNION ALL SELECT file, 'class', cls, 9 FROM src
UNION ALL SELECT file, 'interface', shape, 12 FROM src UNION ALL SELECT file, 'route', upper(verb) || ' ' || path, 16 FROM src""",
)
def _(spark, sf):
    return code.fixture_signals(src(spark, sf).select("file", "content")).select("file", "kind", "name", "line")


@query(
    "ast_extract",
    """SELECT file, 'import' AS kind, NULL AS name, 1 AS line_start, 0.95::DOUBLE AS confidence FROM src UNION ALL SELECT file, 'function', fn, 3, 0.95::DOUBLE FROM src UNION ALL SELECT file, 'function', arrow, 7, 0.9::DOUBLE FROM src
UNION ALL SELECT file, 'class', cls, 9, 0.95::DOUBLE FROM src UNION ALL SELECT file, 'interface', shape, 12, 0.95::DOUBLE FROM src WHERE file NOT LIKE '%.js' UNION ALL SELECT file, 'route', upper(verb) || ' ' || path, 16, 0.95::DOUBLE FROM src""",
)
def _(spark, sf):
    return syntax.structural_signals(src(spark, sf).select("file", "content")).select("file", "kind", "name", "line_start", "confidence")


def wide(spark, sf, template: str, file: str) -> DataFrame:
    """(file, content) with {fn}, {cls}, {module}, {path} and {key} filled in."""
    rows = src(spark, sf)
    names = ("fn", "cls", "shape", "module", "path", "key")

    def filled(text: str):
        parts = re.split(r"\{(" + "|".join(names) + r")\}", text)
        return F.concat(*(F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)))

    return rows.select(filled(file).alias("file"), filled(template).alias("content"))


_DECLARED = """import fs = require('{module}')
export { {fn} as alias } from './{module}'
export * from './{module}'
export * as space from './{module}'
export enum Color{key} { A, B }
export type Alias{key} = string
namespace Space{key} {
}
const expr{key} = function (a) { return a }
@Tagged('x')
export class {cls} extends Base implements {shape} {
  static readonly limit = 3
  size: number = 1
  async load(a) {
    return a
  }
  get total() { return 1 }
  set total(v) { }
}
const holder = {
  run(a) { return a },
}
export default holder
fastify.get('{path}', {fn})
fastify.route({ method: 'POST', url: '{path}', handler: {fn} })
"""


def _rows_sql(file: str, rows: list[tuple[str, str, str, int, str]]) -> str:
    """One SELECT for each expected signal: kind, name and text as SQL, line, framework."""
    return " UNION ALL ".join(f"SELECT {file} AS file, '{k}' AS kind, {n} AS name, {t} AS text, {line} AS line_start, {f} AS framework FROM src" for k, n, t, line, f in rows)


_NONE, _SHOWN = "CAST(NULL AS VARCHAR)", ("file", "kind", "name", "text", "line_start", "framework")


@query(
    "ast_declarations",
    _rows_sql(
        "'src/w' || key || '.ts'",
        [
            ("import", "'fs'", "'import fs = require(''' || module || ''')'", 1, _NONE),
            ("export", _NONE, "'export { alias } from ''./' || module || chr(39)", 2, _NONE),
            ("export", _NONE, "'export * from ''./' || module || chr(39)", 3, _NONE),
            ("export", _NONE, "'export * from ''./' || module || chr(39)", 4, _NONE),
            ("export", "'space'", "'export namespace space'", 4, _NONE),
            ("class", "'Color' || key", "'enum Color' || key", 5, _NONE),
            ("type", "'Alias' || key", "'type Alias' || key || ' = ...'", 6, _NONE),
            ("class", "'Space' || key", "'namespace Space' || key", 7, _NONE),
            ("function", "'expr' || key", "'const expr' || key || ' = function(...) { ... }'", 9, _NONE),
            ("function", "'Tagged'", "'@Tagged(...)'", 10, _NONE),
            ("class", "cls", "'class ' || cls || ' extends Base, ' || shape", 11, _NONE),
            ("class", "'limit'", "'readonly static limit'", 12, _NONE),
            ("class", "'size'", "'size'", 13, _NONE),
            ("function", "'load'", "'async load(...)'", 14, _NONE),
            ("function", "'total'", "'get total'", 17, _NONE),
            ("function", "'total'", "'set total'", 18, _NONE),
            ("function", "'run'", "'run(...)'", 21, _NONE),
            ("export", _NONE, "'export default holder'", 23, _NONE),
            ("route", "'GET ' || path", "'GET ' || path", 24, "'fastify'"),
            ("route", "'POST ' || path", "'POST ' || path", 25, "'fastify'"),
        ],
    ),
)
def _(spark, sf):
    return syntax.structural_signals(wide(spark, sf, _DECLARED, "src/w{key}.ts")).select(*_SHOWN)


@query(
    "ast_assignments",
    _rows_sql("'src/e' || key || '.ts'", [("export", "fn", "'export = ' || fn", 1, _NONE)]) + " UNION ALL " + _rows_sql("'src/s' || key || '.js'", [("function", "fn", "fn || ': function(...) { ... }'", 2, _NONE)]),
)
def _(spark, sf):
    """export = in TypeScript, and members that are functions in JavaScript."""
    files = wide(spark, sf, "export = {fn}\n", "src/e{key}.ts").unionByName(wide(spark, sf, "const holder = {\n  {fn}: function (b) { }\n}\n", "src/s{key}.js"))
    return syntax.structural_signals(files).select(*_SHOWN)


@query(
    "ast_next_routes",
    _rows_sql("'web/app/api/p' || key || '/[id]/route.ts'", [("function", "'GET'", "'async function GET(...)'", 1, _NONE), ("route", "'GET /api/p' || key || '/id'", "'GET /api/p' || key || '/id'", 1, "'nextjs'")])
    + " UNION ALL "
    + _rows_sql("'web/pages/api/p' || key || '/[id].ts'", [("function", "'PUT'", "'async function PUT(...)'", 1, _NONE), ("route", "'PUT /api/p' || key || '/:id'", "'PUT /api/p' || key || '/:id'", 1, "'nextjs'")]),
)
def _(spark, sf):
    app = wide(spark, sf, "export async function GET(request) {\n}\n", "web/app/api/p{key}/[id]/route.ts")
    pages = wide(spark, sf, "export async function PUT(request) {\n}\n", "web/pages/api/p{key}/[id].ts")
    return syntax.structural_signals(app.unionByName(pages)).filter("kind <> 'component'").select(*_SHOWN)


@query(
    "ast_components",
    _rows_sql(
        "'src/v' || key || '.tsx'",
        [
            ("component", "cls", "'function ' || cls || '(...)'", 2, "'react'"),
            ("component", "'Wide' || key", "'const Wide' || key || ' = (...) => ...'", 5, "'react'"),
            ("component", "'Old' || key", "'class Old' || key || ' extends React.Component(...)'", 6, "'react'"),
            ("component", "'Fun' || key", "'const Fun' || key || ' = function(...) { ... }'", 8, "'react'"),
        ],
    ),
)
def _(spark, sf):
    files = wide(spark, sf, "import React from 'react'\nexport function {cls}(props) {\n  return null\n}\nconst Wide{key} = () => null\nclass Old{key} extends React.Component {\n}\nconst Fun{key} = function (p) { return null }\n", "src/v{key}.tsx")
    return syntax.structural_signals(files).filter("kind = 'component'").select(*_SHOWN)


# ---- retrieval


@query("tokenize", "SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[\\n\\r\\p{Z}\\p{P}]+'), lambda x: x <> ''), ' ') AS terms FROM sig")
def _(spark, sf):
    return sig(spark, sf).select("id", F.array_join(E.tokens("text"), " ").alias("terms"))


_FIELDS = """f AS (SELECT id, 'text' AS field, text AS v FROM sig UNION ALL SELECT id, 'name', name FROM sig UNION ALL SELECT id, 'kind', kind FROM sig),
w AS (SELECT id, field, unnest(list_filter(regexp_split_to_array(lower(v), '[\\n\\r\\p{Z}\\p{P}]+'), lambda x: x <> '')) AS term FROM f),
po AS (SELECT field, term, id, count(*) AS tf FROM w GROUP BY ALL),
le AS (SELECT field, id, count(DISTINCT term) AS len FROM w GROUP BY ALL),
av AS (SELECT field, sum(len) / (SELECT count(*) FROM sig) AS a FROM le GROUP BY field)"""
_ASKED = "q AS (SELECT * FROM (VALUES ('q1', 'red'), ('q1', 'bolt'), ('q2', 'small'), ('q2', 'ring'), ('q2', 'route')) v(qid, qterm))"
_BM25 = f"""{_FIELDS}, {_ASKED}, {{match}},
df AS (SELECT field, term, count(*) AS df FROM po GROUP BY ALL),
h AS (SELECT qid, qterm, po.id, weight * CASE po.field WHEN 'name' THEN 4 WHEN 'kind' THEN 2 ELSE 1 END * ln(1 + ((SELECT count(*) FROM sig) - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * len / a))) AS s
  FROM ma JOIN po USING (term) JOIN df USING (field, term) JOIN le ON le.field = po.field AND le.id = po.id JOIN av ON av.field = po.field),
sc AS (SELECT qid, id, floor(sum(s) * count(DISTINCT qterm) * 1000 + 0.5) / 1000 AS score FROM h GROUP BY qid, id)"""
_EXACT = "ma AS (SELECT qid, qterm, qterm AS term, 1.0::DOUBLE AS weight FROM q)"
_VOCAB = "vo AS (SELECT DISTINCT term FROM po)"
_PREFIX = f"{_VOCAB}, ma AS (SELECT qid, qterm, term, CASE WHEN term = qterm THEN 1.0::DOUBLE ELSE 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - length(qterm))) END AS weight FROM q JOIN vo ON starts_with(term, qterm))"
_SMALL = Bm25(boosts=(("text", 1.0), ("name", 4.0), ("kind", 2.0)))


def asked(spark, texts=(("q1", "red bolt"), ("q2", "small ring route"))) -> DataFrame:
    return spark.createDataFrame(list(texts), "qid string, query string")


def index(spark, sf) -> retrieval.Index:
    return retrieval.build_index(sig(spark, sf), settings=_SMALL)


def rounded(frame: DataFrame, places: int = 3) -> DataFrame:
    return frame.withColumn("score", E.decimals(F.col("score"), places))


@query("posting_stats", f"WITH {_FIELDS} SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS tf FROM po GROUP BY field")
def _(spark, sf):
    return index(spark, sf).postings.groupBy("field").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tf"))


@query("bm25_exact", f"WITH {_BM25.replace("{match}", _EXACT)} SELECT qid, id, score FROM sc")
def _(spark, sf):
    return rounded(retrieval.bm25(index(spark, sf), asked(spark), prefix=False, fuzzy=False, settings=_SMALL)).select("qid", "id", "score")


@query("bm25_prefix", f"WITH {_BM25.replace(chr(39) + 'red' + chr(39), chr(39) + 're' + chr(39)).replace("{match}", _PREFIX)} SELECT qid, id, score FROM sc")
def _(spark, sf):
    return rounded(retrieval.bm25(index(spark, sf), asked(spark, (("q1", "re bolt"), ("q2", "small ring route"))), fuzzy=False, settings=_SMALL)).select("qid", "id", "score")


@query(
    "bm25_fuzzy",
    f"""WITH {_FIELDS}, {_VOCAB}, a AS (SELECT 'funtion' AS qterm) SELECT qterm, term, floor(0.45::DOUBLE * length(term) / (length(term) + levenshtein(term, qterm)) * 1000000 + 0.5) / 1000000 AS weight FROM a, vo WHERE levenshtein(term, qterm) BETWEEN 1 AND 1""",
)
def _(spark, sf):
    terms = retrieval.query_terms(asked(spark, (("q1", "funtion"),)))
    found = retrieval.matching_terms(index(spark, sf), terms, settings=_SMALL)
    return found.withColumn("weight", E.decimals(F.col("weight"), 6))


@query("bm25_topk", f"WITH {_BM25.replace("{match}", _EXACT)}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM sc) SELECT qid, id, score, rank FROM r WHERE rank <= 24")
def _(spark, sf):
    return retrieval.top(rounded(retrieval.bm25(index(spark, sf), asked(spark), prefix=False, fuzzy=False, settings=_SMALL)), 24).select("qid", "id", "score", "rank")


def _structural_sql(q: str) -> str:
    """The structural score of sig against one literal query, term by term."""
    terms = q.split(" ")
    has = lambda c, v: " + ".join(f"CASE WHEN contains({c}, '{w}') THEN {v} ELSE 0 END" for w in terms)
    base = "string_split(file, '/')[-1]"
    tag = lambda g: " + ".join(f"CASE WHEN {g} = '{w}' THEN 1.5 WHEN contains({g}, '{w}') THEN 3.0::DOUBLE * 0.2 ELSE 0 END" for w in terms)
    return f"""(CASE WHEN lower(name) = '{q}' THEN 8.0 WHEN contains(lower(name), '{q}') THEN 4.0 ELSE {has("lower(name)", "2.0")} END)::DOUBLE
 + (CASE WHEN path IS NULL THEN 0.0 WHEN contains('{q}', path) THEN 4.0 ELSE {has("path", "4.0 * 0.3")} END)::DOUBLE + (CASE WHEN method IS NOT NULL AND contains('{q}', lower(method)) THEN 2.0 ELSE 0 END)::DOUBLE
 + (CASE WHEN contains('{q}', {base}) THEN 2.0 ELSE 0 END)::DOUBLE + ({has(base, "2.0 * 0.3")})::DOUBLE
 + ({tag("kind")})::DOUBLE + ({tag("lower(p_brand)")})::DOUBLE + ({tag("'size' || p_size")})::DOUBLE + ({has("lower(text)", "0.3")})::DOUBLE"""


_STRUCT = "st AS (SELECT id, key, kind, floor((" + _structural_sql("get red route") + ") * 100 + 0.5) / 100 AS score FROM sig)"


def _structural(spark, sf) -> DataFrame:
    return rounded(sig(spark, sf).withColumn("score", retrieval.structural_score(F.lit("get red route"), Scoring())), 2)


@query("structural_score", f"WITH {_STRUCT} SELECT id, score FROM st")
def _(spark, sf):
    return _structural(spark, sf).select("id", "score")


@query("score_and_sort", f"WITH {_STRUCT}, r AS (SELECT id, key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM st WHERE score >= 0.1) SELECT id, score, CAST(rank AS INT) AS rank FROM r")
def _(spark, sf):
    ranked = retrieval.score_and_sort(sig(spark, sf), F.broadcast(asked(spark, (("q", "get red route"),))), tie="key")
    return rounded(ranked, 2).select("id", "score", "rank")


@query("max_normalise", f"WITH {_STRUCT} SELECT id, floor(score / greatest(max(score) OVER (), 0.001) * 100 + 0.5) / 100 AS score FROM st WHERE score >= 0.1")
def _(spark, sf):
    return retrieval.normalised(_structural(spark, sf).filter("score >= 0.1").withColumn("qid", F.lit("q"))).select("id", "score")


_SLICE = f"""WITH {_STRUCT}, n AS (SELECT st.id, st.key, floor(score / greatest(max(score) OVER (), 0.001) * 100 + 0.5) / 100 AS score FROM st WHERE score >= 0.1),
d AS (SELECT n.id, n.key, n.score, row_number() OVER (PARTITION BY s.kind, s.file, s.name, s.line_start, s.text ORDER BY n.score DESC, n.key) AS rn FROM n JOIN sig s USING (id) WHERE n.score >= 0.05),
r AS (SELECT id, key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM d WHERE rn = 1)
SELECT id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"""


@query("search_slice", _SLICE)
def search_slice(spark, sf):
    """Score, normalise, threshold, dedup, top 8: one query through the whole of ranking."""
    found = retrieval.normalised(_structural(spark, sf).filter("score >= 0.1").withColumn("qid", F.lit("q"))).filter("score >= 0.05")
    once = merge.first_wins(found, [E.line_key().alias("k")], [F.col("score").desc(), "key"])
    return retrieval.top(once, 8, tie="key").select("id", "score", "rank")


_HYBRID = f"""WITH {_BM25.replace("('q1', 'red'), ('q1', 'bolt'), ('q2', 'small'), ('q2', 'ring'), ('q2', 'route')", "('q', 'get'), ('q', 'red'), ('q', 'route')").replace("{match}", _EXACT)}"""


_HYBRID += f""", tc AS (SELECT id, floor(score * 100 + 0.5) / 100 AS b, row_number() OVER (ORDER BY score DESC, id) AS br FROM sc QUALIFY br <= 24),
{_STRUCT}, co AS (SELECT tc.id, br, floor((0.7::DOUBLE * b + 0.3::DOUBLE * st.score) * 100 + 0.5) / 100 AS s FROM tc JOIN st USING (id)),
no AS (SELECT id, br, floor(s / greatest(max(s) OVER (), 0.001) * 100 + 0.5) / 100 AS score FROM co),
on_ AS (SELECT no.*, row_number() OVER (PARTITION BY s.kind, s.file, s.name, s.line_start, s.text ORDER BY score DESC, br) AS rn FROM no JOIN sig s USING (id) WHERE score >= 0.05)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, br) AS INT) AS rank FROM on_ WHERE rn = 1 QUALIFY rank <= 8"""


@query("hybrid_exact", _HYBRID.replace("floor(sum(s) * count(DISTINCT qterm) * 1000 + 0.5) / 1000 AS score", "floor(sum(s) * count(DISTINCT qterm) * 1000000000 + 0.5) / 1000000000 AS score"))
def _(spark, sf):
    found = retrieval.hybrid_search(sig(spark, sf), asked(spark, (("q", "get red route"),)), Search(), prefix=False, fuzzy=False, weights=_SMALL)
    return found.select("id", "score", "rank")


_FIELDS_ALL = _FIELDS.replace(
    "UNION ALL SELECT id, 'kind', kind FROM sig)",
    "UNION ALL SELECT id, 'kind', kind FROM sig UNION ALL SELECT id, 'file', file FROM sig UNION ALL SELECT id, 'language', language FROM sig UNION ALL SELECT id, 'tags', concat_ws(',', kind, p_brand, 'size' || p_size) FROM sig)",
)
_ANY_MATCH = f"""{_VOCAB}, ma AS (SELECT qid, qterm, term, CASE WHEN term = qterm THEN 1.0::DOUBLE WHEN starts_with(term, qterm) THEN 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - length(qterm)))
  ELSE 0.45::DOUBLE * length(term) / (length(term) + levenshtein(term, qterm)) END AS weight FROM q JOIN vo ON starts_with(term, qterm) OR levenshtein(term, qterm) BETWEEN 1 AND floor(length(qterm) * 0.15 + 0.5))"""


def _hybrid_sql(queries: list[tuple[str, str]], columns: str, pre: str = "TRUE", post: str = "TRUE", as_reference: bool = False, limit: int = 8) -> str:
    """Ranked search over all fields with exact, prefix and fuzzy terms."""
    asked = ", ".join(f"('{i}', '{x}')" for i, x in queries)
    terms = rf"q AS (SELECT DISTINCT qid, unnest(list_filter(regexp_split_to_array(lower(t), '[\n\r\p{{Z}}\p{{P}}]+'), lambda x: x <> '')) AS qterm FROM (VALUES {asked}) v(qid, t))"
    scored = _BM25.replace(_FIELDS, _FIELDS_ALL).replace(_ASKED, terms).replace("{match}", _ANY_MATCH)
    scored = scored.replace("CASE po.field WHEN 'name' THEN 4 WHEN 'kind' THEN 2 ELSE 1 END", "CASE po.field WHEN 'name' THEN 4 WHEN 'tags' THEN 3 WHEN 'kind' THEN 2 WHEN 'file' THEN 2 ELSE 1 END")
    scored = scored.replace("floor(sum(s) * count(DISTINCT qterm) * 1000 + 0.5) / 1000 AS score", "floor(sum(s) * count(DISTINCT qterm) * 1000000000 + 0.5) / 1000000000 AS score")
    structural = "CASE qid " + " ".join(f"WHEN '{i}' THEN {_structural_sql(x.lower())}" for i, x in queries) + " END"
    order = "br" if as_reference else "score DESC, br"
    return f"""WITH {scored}, tc AS (SELECT qid, sc.id, floor(score * 100 + 0.5) / 100 AS b, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sc.id) AS br FROM sc JOIN sig USING (id) WHERE {pre} QUALIFY br <= {3 * limit}),
co AS (SELECT qid, tc.id, br, floor((0.7::DOUBLE * b + 0.3::DOUBLE * ({structural})) * 100 + 0.5) / 100 AS s FROM tc JOIN sig USING (id) WHERE {post}),
no AS (SELECT qid, id, br, floor(s / greatest(max(s) OVER (PARTITION BY qid), 0.001) * 100 + 0.5) / 100 AS score FROM co),
li AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS place FROM no WHERE score >= 0.05 {f"QUALIFY place <= {limit}" if as_reference else ""}),
on_ AS (SELECT li.*, s.kind, s.name, s.file, s.method, row_number() OVER (PARTITION BY qid, s.kind, s.file, s.name, s.line_start, s.text ORDER BY {order}) AS rn FROM li JOIN sig s USING (id)),
hy AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}) AS INT) AS rank FROM on_ WHERE rn = 1 QUALIFY rank <= {limit})
SELECT {columns} FROM hy"""


_TWO = [("q1", "red bolt route"), ("q2", "small ring class")]


@query("hybrid_search", _hybrid_sql(_TWO, "qid, rank, score, id, kind, name"))
def hybrid_query(spark, sf):
    return retrieval.hybrid_search(sig(spark, sf), asked(spark, _TWO), Search()).select("qid", "rank", "score", "id", "kind", "name")


@query("hybrid_prefilter", _hybrid_sql([("q1", "red bolt"), ("q2", "small ring route")], "qid, rank, score, id, kind, file", pre="kind = 'route' AND contains(lower(file), 'brand-1')"))
def _(spark, sf):
    return retrieval.hybrid_search(sig(spark, sf), asked(spark), Search(), kind="route", file="brand-1").select("qid", "rank", "score", "id", "kind", "file")


@query("search_as_reference", _hybrid_sql(_TWO, "qid, rank, score, id, kind, name, file", as_reference=True))
def _(spark, sf):
    return retrieval.search_as_reference(sig(spark, sf), asked(spark, _TWO)).select("qid", "rank", "score", "id", "kind", "name", "file")


@query("search_as_reference_filtered", _hybrid_sql(_TWO, "qid, rank, score, id, kind, name, file", post="kind = 'route'", as_reference=True))
def _(spark, sf):
    return retrieval.search_as_reference(sig(spark, sf), asked(spark, _TWO), kind="route").select("qid", "rank", "score", "id", "kind", "name", "file")


@query(
    "cosine_topk",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e),
c AS (SELECT CAST(a.vec_id AS VARCHAR) AS qid, b.vec_id AS id, floor(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.s * b.s) * 1000000 + 0.5) / 1000000 AS score FROM n a, n b WHERE a.vec_id < 5),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM c) SELECT qid, id, score, rank FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.filter("id < 5").select(F.col("id").cast("string").alias("qid"), F.col("v").alias("qv"))
    scored = rounded(v.crossJoin(F.broadcast(q)).withColumn("score", retrieval.cosine(F.col("qv"), F.col("v"))), 6).select("qid", "id", "score")
    return retrieval.top(scored, 10).select("qid", "id", "score", "rank")


@query(
    "cosine_by_label",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0)
SELECT label, count(*) AS n, floor(avg(list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.v, lambda x: x * x))))) * 100000 + 0.5) / 100000 AS score FROM e, q GROUP BY label""",
)
def _(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("qv"))
    per = e.crossJoin(F.broadcast(q)).groupBy("label").agg(F.count("*").alias("n"), F.avg(retrieval.cosine(F.col("qv"), F.col("embedding"))).alias("score"))
    return rounded(per, 5)


def every_50th(spark, sf):
    """All embeddings as (id, v, label), and those with an id divisible by 50 as queries (qid, qv)."""
    v = t(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("v"), "label")
    return v, v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))


_COSINES = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e),
c AS (SELECT CAST(a.vec_id AS VARCHAR) AS qid, b.vec_id AS id, b.label, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.s * b.s) AS cosine FROM n a, n b WHERE a.vec_id % 50 = 0)"""


@query(
    "cosine_topk_every50",
    f"""WITH {_COSINES}, f AS (SELECT qid, id, floor(cosine * 1000000 + 0.5) / 1000000 AS score FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM f) SELECT qid, id, score, rank FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    v, q = every_50th(spark, sf)
    return retrieval.cosine_top_k_blocks(q, v, 10).select(F.col("qid").cast("string").alias("qid"), "id", "score", "rank")


@query("cosine_by_label_every50", f"WITH {_COSINES} SELECT qid, label, count(*) AS n, floor(avg(cosine) * 100000 + 0.5) / 100000 AS score FROM c GROUP BY qid, label")
def _(spark, sf):
    v, q = every_50th(spark, sf)
    return rounded(retrieval.cosine_means(q, v, "label"), 5).select(F.col("qid").cast("string").alias("qid"), "label", "n", "score")


@query(
    "hash_embedding",
    """WITH t AS (SELECT id, trim(concat_ws(' ', name, text, concat_ws(' ', kind, p_brand, 'size' || p_size))) AS t FROM sig),
h AS (SELECT id, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) AS hash FROM t),
v AS (SELECT id, hash, list_transform(range(16), lambda i: sin((hash + i)::DOUBLE) * 10000 - floor(sin((hash + i)::DOUBLE) * 10000)) AS v FROM h),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS norm FROM v)
SELECT id, hash, array_to_string(list_transform(v, lambda x: CAST(floor(x / norm * 1000000 + 0.5) AS BIGINT)), ',') AS vector FROM n""",
)
def _(spark, sf):
    """The vector's components as millionths."""
    v = retrieval.hash_embedding(retrieval.signal_text(), 16)
    return sig(spark, sf).select("id", retrieval.text_hash(retrieval.signal_text()).alias("hash"), F.array_join(F.transform(v, lambda x: E.half_up(x * 1_000_000).cast("string")), ",").alias("vector"))


# ---- evaluation

_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_TERMS = f"list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))[1:5]"


@query("search_terms", f"SELECT item_id, array_to_string({_TERMS.replace('query', 'text')}, ' ') AS terms FROM benchmark")
def _(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", F.array_join(E.search_terms("text"), " ").alias("terms"))


_GT = "gt AS (SELECT CAST(p_partkey AS VARCHAR) AS id, concat('find ', lower(p_name), ' ', lower(p_type)) AS query, CASE WHEN p_partkey % 2 = 0 THEN 'route' ELSE 'class' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS handler, CASE WHEN p_partkey % 4 = 0 THEN 'brand-1' END AS want FROM part WHERE p_partkey < 15)"


def ground_truth(spark, sf) -> DataFrame:
    p = t(spark, sf, "part").filter("p_partkey < 15")
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    expected = F.struct(F.when(k % 2 == 0, "route").otherwise("class").alias("kind"), none.alias("method"), none.alias("path"), F.when(k % 4 == 0, "brand-1").alias("file"), F.when(k % 3 == 0, F.col("p_name")).alias("handler"), (k % 2 == 0).alias("lineRequired"))
    return p.select(k.cast("string").alias("id"), F.concat(F.lit("find "), F.lower("p_name"), F.lit(" "), F.lower("p_type")).alias("query"), F.when(k % 2 == 0, "navigation").otherwise("symbol").alias("category"), expected.alias("expected"))


def as_fixture(spark, sf) -> DataFrame:
    return sig(spark, sf).select("kind", "name", "file", F.col("line_start").alias("line"), "text", F.col("key").alias("pos"))


_HITS = f"""{_GT}, a AS (SELECT *, {_TERMS} AS terms FROM gt), m AS (SELECT a.id, a.kind AS want_kind, a.handler, a.want, s.*, len(list_filter(terms, lambda x: contains(lower(concat_ws(' ', s.kind, s.name)), x))) AS hits
  FROM a JOIN (SELECT kind, name, file, line_start AS line, text, key AS pos FROM sig) s ON len(list_filter(terms, lambda x: contains(lower(concat_ws(' ', s.kind, s.name, s.file)), x))) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, pos) AS rank, (kind = want_kind) AND (handler IS NULL OR contains(lower(name), lower(handler)) OR contains(lower(handler), lower(name))) AND (want IS NULL OR contains(file, want)) AS ok FROM m)"""


@query("query_signal_theta", f"WITH {_HITS} SELECT id, pos, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def _(spark, sf):
    return evaluate.signal_matches(ground_truth(spark, sf), as_fixture(spark, sf), 5).select("id", "pos", "rank")


_SIGNAL_BENCHMARK = f"""WITH {_HITS}, p AS (SELECT id, count(*) AS count, max(CASE WHEN rank = 1 THEN length(text) END) AS chars, bool_or(rank = 1 AND ok) AS one, bool_or(rank <= 3 AND ok) AS three FROM k WHERE rank <= 5 GROUP BY id)
SELECT gt.id, coalesce(count, 0) AS count, CAST(coalesce(chars, 0) AS BIGINT) AS chars_read, CAST(floor(coalesce(chars, 0) / 4 + 0.5) AS BIGINT) AS tokens, CASE WHEN one THEN 3 WHEN three THEN 2 WHEN count > 0 THEN 1 ELSE 0 END AS correctness FROM gt LEFT JOIN p USING (id)"""


@query("signal_benchmark", _SIGNAL_BENCHMARK)
def _(spark, sf):
    return evaluate.signal_benchmark(ground_truth(spark, sf), as_fixture(spark, sf)).drop("results")


@query(
    "real_signals",
    f"""WITH {_HITS} SELECT gt.id, CAST(CASE WHEN ok THEN 3 WHEN k.id IS NOT NULL THEN 1.5 ELSE 0 END AS DOUBLE) AS correctness, CAST(coalesce(length(text), 0) AS BIGINT) AS chars_read, CAST(floor(coalesce(length(text), 0) / 4 + 0.5) AS BIGINT) AS tokens, k.id IS NOT NULL AS top3_hit FROM gt LEFT JOIN (SELECT * FROM k WHERE rank = 1) k USING (id)""",
)
def _(spark, sf):
    return evaluate.real_signals(ground_truth(spark, sf), as_fixture(spark, sf))


def as_files(spark, sf) -> DataFrame:
    return sig(spark, sf).select(F.col("file").alias("path"), F.concat_ws("\n", "text", F.concat(F.lit("class "), "name")).alias("content"), F.col("key").alias("ordinal"))


_FILES = f"""{_GT}, fi AS (SELECT file AS path, string_split(file, '/')[-1] AS base, concat(text, chr(10), 'class ', name) AS content, key AS ordinal FROM sig), li AS (SELECT *, length(content) AS chars, lower(content) AS low FROM fi)"""
_AGENT = f"""WITH {_FILES}, a AS (SELECT *, {_TERMS} AS terms, array_to_string(string_split(lower(query), ' ')[1:2], ' ') AS head FROM gt),
p AS (SELECT a.id, kind, handler, want, li.*, row_number() OVER (PARTITION BY a.id ORDER BY len(list_filter(terms, lambda x: contains(base, x))) + CAST(contains(base, 'route') OR contains(base, 'handler') AS INT) DESC, ordinal) AS rank
  FROM a JOIN li ON (want IS NULL OR contains(path, want)) AND (len(list_filter(terms, lambda x: contains(base, x) OR contains(path, x))) > 0 OR (len(terms) > 0 AND contains(base, head)))),
t AS (SELECT id, max(rank) AS n, max(CASE WHEN rank = 1 THEN chars END) AS c1, coalesce(max(CASE WHEN rank = 2 THEN chars END), 0) AS c2, sum(chars) AS c3,
  bool_or(rank = 1 AND (handler IS NULL OR CASE kind WHEN 'route' THEN contains(low, lower(handler)) ELSE contains(low, 'class ' || lower(handler)) OR contains(low, 'interface ' || lower(handler)) END)) AS ok FROM p WHERE rank <= 3 GROUP BY id),
lost AS (SELECT sum(chars) AS lost FROM (SELECT chars FROM li ORDER BY ordinal LIMIT 5)),
r AS (SELECT gt.id, n, CASE WHEN n IS NULL THEN 0 WHEN ok THEN 3 ELSE 2 END AS correctness, CASE WHEN n IS NULL THEN lost WHEN ok THEN 2 * c1 ELSE c1 + c2 END AS chars, CASE WHEN n IS NULL THEN 5 WHEN ok THEN 1 ELSE least(n, 2) - 1 END AS full_reads FROM gt LEFT JOIN t USING (id), lost)
SELECT id, 1 AS tool_calls, CAST(full_reads AS BIGINT) AS full_reads, CAST(n IS NOT NULL AS INT) AS targeted_reads, CAST(chars AS BIGINT) AS chars_read, CAST(floor(chars / 4 + 0.5) AS BIGINT) AS tokens, correctness FROM r"""


@query("agent_baseline", _AGENT)
def _(spark, sf):
    return evaluate.agent_baseline(ground_truth(spark, sf), as_files(spark, sf))


_REAL = f"""WITH {_FILES}, a AS (SELECT *, {_TERMS.replace(_STOP, ", ".join(f"'{w}'" for w in rules.STOP_WORDS_SHORT))} AS terms, array_to_string(string_split(lower(query), ' ')[1:3], ' ') AS head, list_filter(string_split(lower(query), ' '), lambda w: length(w) > 3) AS words FROM gt),
p AS (SELECT a.*, li.path, base, content, ordinal, chars, low FROM a, li),
f1 AS (SELECT id, chars AS c1, (want IS NULL OR contains(path, want)) AND (handler IS NULL OR CASE kind WHEN 'route' THEN contains(low, lower(handler)) ELSE contains(low, 'class ' || lower(handler)) END) AND len(list_filter(words, lambda w: contains(low, w))) >= greatest(1, floor(len(words) * 0.5)) AS m
  FROM p WHERE len(list_filter(terms, lambda x: contains(base, x) OR contains(path, x))) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1),
f5 AS (SELECT id, sum(chars) AS c5, count(*) AS n5, count(*) FILTER (WHERE contains(low, head)) AS t5 FROM p WHERE ordinal < 5 GROUP BY id),
r AS (SELECT gt.*, c1, coalesce(m, false) AS m, c5, n5, t5, c1 IS NOT NULL AS got FROM gt LEFT JOIN f1 USING (id) JOIN f5 USING (id)),
z AS (SELECT *, coalesce(c1, 0) + CASE WHEN m THEN 2 * c1 ELSE 0 END + c5 AS chars, least(3.0::DOUBLE, 1.5 + CASE WHEN want IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN kind = 'route' THEN 1.0 ELSE 0 END) AS grade FROM r)
SELECT id, CAST(1 + CAST(got AS INT) + n5 AS BIGINT) AS tool_calls, CAST(CAST(m AS INT) + CASE WHEN got THEN t5 ELSE 0 END AS BIGINT) AS full_reads, CAST(CAST(got AS INT) + t5 AS BIGINT) AS targeted_reads,
  CAST(chars AS BIGINT) AS chars_read, CAST(floor(chars / 4 + 0.5) AS BIGINT) AS tokens, CAST(CASE WHEN got THEN grade ELSE 0 END AS DOUBLE) AS correctness FROM z"""


@query("real_baseline", _REAL)
def _(spark, sf):
    return evaluate.real_baseline(ground_truth(spark, sf), as_files(spark, sf))


_COMPARED = f"""WITH ag AS ({_AGENT}), sb AS ({_SIGNAL_BENCHMARK}),
t AS (SELECT CAST(sum(chars_read) AS BIGINT) AS bc, floor(sum(tokens) / count(*) + 0.5) AS bt, floor(sum(correctness) / count(*) * 100 + 0.5) / 100 AS ba, sum(tool_calls) AS calls FROM ag),
u AS (SELECT floor(sum(tokens) / count(*) + 0.5) AS st, floor(sum(correctness) / count(*) * 100 + 0.5) / 100 AS sa, floor(count(*) FILTER (WHERE correctness >= 2) * 100 / count(*) * 10 + 0.5) / 10 AS hit, count(*) AS n FROM sb),
m AS (SELECT *, floor((bt - st) / bt * 100 + 0.5) AS r1, floor((calls - n) / calls * 100 + 0.5) AS r2, CASE WHEN bt > st THEN ceil(bc / (bt - st)) ELSE 999 END AS ev FROM t, u)
SELECT 'storage_reduction' AS metric, 500000::DOUBLE AS baseline, 100000::DOUBLE AS signals, 80::DOUBLE AS reduction, true AS success
UNION ALL SELECT 'query_context', bt::DOUBLE, st::DOUBLE, r1::DOUBLE, r1 >= 20 FROM m UNION ALL SELECT 'tool_calls', calls::DOUBLE, n::DOUBLE, r2::DOUBLE, r2 > 0 FROM m
UNION ALL SELECT 'accuracy', ba::DOUBLE, sa::DOUBLE, 0::DOUBLE, sa >= ba - 0.3::DOUBLE FROM m UNION ALL SELECT 'top3_hit_rate', 0::DOUBLE, hit::DOUBLE, hit::DOUBLE, hit >= 70 FROM m
UNION ALL SELECT 'break_even', 0::DOUBLE, ev::DOUBLE, 0::DOUBLE, ev < 50 FROM m"""


@query("comparison_metrics", _COMPARED)
def _(spark, sf):
    q = ground_truth(spark, sf)
    return evaluate.comparison(evaluate.agent_baseline(q, as_files(spark, sf)), evaluate.signal_benchmark(q, as_fixture(spark, sf)), F.lit(500_000), F.lit(2000))


def _top1_sql(name: str) -> str:
    rows = evaluate.DEFAULT_QUERIES if name == "default" else evaluate.NAVIGATION_QUERIES
    said = lambda x: "NULL" if x is None else f"'{x}'"
    wanted = ", ".join(f"('q{i}', {', '.join(map(said, q[1:]))})" for i, q in enumerate(rows))
    found = _hybrid_sql([(f"q{i}", q[0]) for i, q in enumerate(rows)], "qid, kind AS r_kind, method AS r_method, file AS r_file, rank")
    return f"""WITH fo AS ({found}), wa AS (SELECT * FROM (VALUES {wanted}) w(id, kind, method, part))
SELECT wa.id, coalesce(kind = r_kind, false) OR coalesce(upper(method) = upper(r_method), false) OR coalesce(contains(r_file, part), false) AS correct FROM wa LEFT JOIN fo ON fo.qid = wa.id AND rank = 1"""


@query("top1_accuracy", _top1_sql("default"))
def _(spark, sf):
    q = evaluate.query_set(spark)
    found = retrieval.hybrid_search(sig(spark, sf), q.select(F.col("id").alias("qid"), "query"), Search())
    return evaluate.top1_accuracy(q, found)


@query("navigation_benchmark", _top1_sql("navigation"))
def _(spark, sf):
    return evaluate.navigation_benchmark(spark, lambda q: retrieval.hybrid_search(sig(spark, sf), q, Search()))


_NOISE = "((('0x' || substr(md5('0:{}:' || id), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE)"


@query(
    "simulated_baseline",
    f"""WITH {_GT}, n AS (SELECT id, CAST(2 + floor({_NOISE.format("reads")} * 4) AS BIGINT) AS reads, {_NOISE.format("size")} AS size, {_NOISE.format("grade")} AS grade FROM gt),
c AS (SELECT *, CAST(floor(reads * (34000::DOUBLE / 47) * (0.8::DOUBLE + 0.4::DOUBLE * size) + 0.5) AS BIGINT) AS chars FROM n)
SELECT id, reads + 1 AS tool_calls, reads AS full_reads, chars AS chars_read, CAST(floor(chars / 4 + 0.5) AS BIGINT) AS tokens, floor((1.0::DOUBLE + grade) * 100 + 0.5) / 100 AS correctness FROM c""",
)
def _(spark, sf):
    return evaluate.simulated_baseline(ground_truth(spark, sf), 47, 34_000)


@query(
    "simulated_signals",
    f"""WITH {_GT}, n AS (SELECT id, {_NOISE.format("chars")} AS a, {_NOISE.format("found")} AS b, {_NOISE.format("match")} AS c FROM gt), c AS (SELECT *, CAST(floor(200 + 400 * a + 0.5) AS BIGINT) AS chars FROM n)
SELECT id, CAST(1 + floor(b * 3) AS BIGINT) AS count, chars AS chars_read, CAST(floor(chars / 4 + 0.5) AS BIGINT) AS tokens, floor((2.0::DOUBLE + c) * 100 + 0.5) / 100 AS correctness FROM c""",
)
def _(spark, sf):
    return evaluate.simulated_signals(ground_truth(spark, sf))


@query(
    "ground_truth_validate",
    "SELECT CAST(item_id AS VARCHAR) AS id, e AS error FROM (SELECT item_id, unnest(list_filter([CASE WHEN item_id % 5 = 0 THEN 'missing query' END, CASE WHEN item_id % 7 = 0 THEN 'missing category' END, CASE WHEN item_id % 4 = 0 THEN 'missing expected kind' END], lambda x: x IS NOT NULL)) AS e FROM benchmark)",
)
def _(spark, sf):
    i = F.col("item_id")
    rows = t(spark, sf, "benchmark").select(i.cast("string").alias("id"), F.when(i % 5 != 0, F.col("text")).alias("query"), F.when(i % 7 != 0, "nav").alias("category"), F.struct(F.when(i % 4 != 0, "class").alias("kind")).alias("expected"))
    return evaluate.validate_ground_truth(rows)
