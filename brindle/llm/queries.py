"""The registered queries: thin digests over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licenses, linededup, mixing, ngramjoin, pii, quality, topk, urls
from .shared import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' files are; other callers hand the operators a path of their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), round_trip=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(spans)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "spans.label")).alias("labels"),
        "score",
    )


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
        sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM s),
l AS (SELECT max({'w': rest_weight, 'x': rest_words}) AS level FROM f WHERE cap * rest_weight > rest_words * weight),
t AS (SELECT source, source_size, CASE WHEN cap * rest_weight <= rest_words * weight THEN CAST(cap AS DOUBLE) ELSE CAST(level.x AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(level.w AS DOUBLE) END AS target FROM f, l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.goal,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS running
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - running)) END AS BIGINT) AS taken
FROM p"""


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


#: Scores from here on count as label 1.
THRESHOLD = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, carry=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


#: The registered query's key: of no use but to make its results agree.  Callers of protect bring their own secret.
EXAMPLE_KEY = b"an example, no secret"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.protect(table(spark, sf_dir, "documents"), EXAMPLE_KEY)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        F.size("spans").cast("bigint").alias("n_found"),
        *(count(k).alias(f"n_{k}") for k in (*pii.KINDS, "secret")),
        F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"),
        F.col("clean").alias("text"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngramjoin": op1_ngramjoin,
    "op2_bpe": op2_bpe,
    "op3_licenses": op3_licenses,
    "op4_topk": op4_topk,
    "op5_linededup": op5_linededup,
    "op6_mixing": op6_mixing,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_ann": op9_ann,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk": OP4_SQL,
    "op5_linededup": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_urls": urls.judge_sql(),
}
