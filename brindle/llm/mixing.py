"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source asks for its weight's share of the words to take.  A source stops at `max_epochs` times its own
size; what it can't take goes to the others by weight, until none is above.  That fixed point is one level for
all sources that aren't full, so it is found by one pass over the sources in the order in which they fill up.

A target is met by whole repetitions of the source and, for the rest, by a seeded random order of its
documents: they are taken one more time until the rest is used up, the last one in part.  Positions in that order
are running sums within buckets of a seeded hash, four for each shuffle partition at least, added to the sizes of the buckets before, so a source with
a third of all rows is no single task.  Per source and bucket, rows are summed before they are shuffled.

Null text has no words.  Null is a source of its own, last in order.  A source without words gets target 0.
Rows with equal doc_id are rows of their own: equal ones may exchange what they get.  An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions

#: Words are runs of anything but x20 and x09-x0D.
WORD = r"[^\x20\x09-\x0D]+"


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(per_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Adds weight and target to (source, source_size): one row for each source, so its windows are small.

    weights repeat over the sources in code point order, null last.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * max_epochs).withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    fills = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = weighted.withColumn("left", left).withColumn("rest", F.sum("weight").over(after))
    full = F.col("cap") * F.col("rest") <= F.col("left") * F.col("weight")
    ranked = ranked.withColumn("full", full)
    # The first source that doesn't fill up has the largest `rest` of those.
    first = F.max(F.when(~F.col("full"), F.struct("rest", "left"))).over(everything)
    return ranked.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.rest")).alias("target"),
    )


def mix(docs: DataFrame, carry: list[str], source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """Every row's `carry` columns as struct `row`, with size, source_size, target, and taken (words, repeats counted).

    taken = repeats * size + extra, extra being the words of the fractional repetition.
    """
    digits = max(2, -(-((4 * shuffle_partitions(docs.sparkSession)).bit_length()) // 4))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[key].cast("string"), F.lit("null"))))
    rows = docs.select(
        F.struct(*(docs[c] for c in carry)).alias("row"),
        docs[source].alias("source"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        order.alias("place"),
    ).withColumn("bucket", F.substring("place", 1, digits))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    goals = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, max_epochs)
    goal = F.floor(F.col("target") + 0.5).cast("bigint")
    some = F.col("source_size") > 0
    goals = goals.select(
        F.col("source").alias("g_source"),
        "source_size",
        "target",
        F.when(some, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).alias("repeats"),
        F.when(some, goal % F.col("source_size")).otherwise(F.lit(0)).alias("rest"),
    )
    before = F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = parts.withColumn("before", before).join(goals, _same(F.col("source"), F.col("g_source")))
    plan = plan.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "before", "source_size", "target", "repeats", "rest")
    running = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("running", running).join(plan, _same(F.col("source"), F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("running")))
    return placed.select("row", "size", "source_size", "target", "repeats", extra.cast("bigint").alias("extra"), (F.col("repeats") * F.col("size") + extra).cast("bigint").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix's rows: `row` as often as it is taken; the fractional repetition counts from half the document on."""
    times = F.col("repeats") + F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    return mixed.withColumn("times", times.cast("int")).filter("times > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_")).drop("copy_")
