"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, byte-pair encoding.

Every stage takes (spark, docs, sf_dir), docs being what its predecessor returned, and works on all of it.  The
stages' decisions take effect: rejected documents go, dropped lines are gone from the texts, one document of each group of
near copies stays, the mix repeats documents or leaves them out, and the last stage returns the tokens.
All stages but the last return the columns of documents.

Texts that a stage changes get the n_chars of what is left.  Null texts pass as they are until lines are dropped,
which gives the empty text.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, linededup, mixing, ngramjoin, quality
from brindle.llm.queries import THRESHOLD, vocabulary
from brindle.llm.shared import bounded_batches, checkpointed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.  It is fit on a bounded sample of the labelled rows among docs."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=COLUMNS).filter(F.col("score") >= THRESHOLD).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share, except where the line stays."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    changed = F.col("n_dropped") > 0
    return kept.select(
        "row.doc_id",
        F.when(changed, F.col("kept")).otherwise(F.col("row.text")).alias("text"),
        "row.lang",
        "row.source",
        F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars"),
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, null ids last; of rows that share it, one.

    Rows are told apart by their sets, not by doc_id, which may repeat.  Texts without words are copies of nothing:
    of those only rows that share a doc_id and all else count once.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = ngramjoin.similar_groups(docs).filter("node is not null")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("chosen_id"), F.col("first.node").alias("chosen_node"))
    rows = ngramjoin.with_nodes(docs)
    kept = rows.join(chosen, (rows["node"] == chosen["chosen_node"]) & rows["doc_id"].eqNullSafe(chosen["chosen_id"]), "left_semi")
    lone = kept.groupBy("doc_id", "node").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    empty = rows.filter("node is null").drop("node")
    return lone.unionByName(empty.filter("doc_id is not null").dropDuplicates()).unionByName(empty.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    bounded_batches(spark)
    return mixing.repeated(mixing.mix(docs, carry=COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers) and the digests of ids and decoded text."""
    bounded_batches(spark)
    coded = bpe.encode(docs, vocabulary(), round_trip=True)
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", one_of_each),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: The classifier and the tokenizer can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
