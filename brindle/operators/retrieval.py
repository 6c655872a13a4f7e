"""Ranked retrieval: a field-boosted index with exact, prefix and fuzzy terms, a structural score, their hybrid, vectors.

The index is a relation of postings (field, term, id, tf) with field lengths beside it; it can be written once and
queried by joins.  Queries are a relation too: any number are answered by one plan.  Query terms are joined to the
distinct vocabulary first (by equality, by a common beginning, and by bounded edit distance between terms of about the
same length and a common letter), and postings and their frequencies are read only for terms that count.  `IndexStore` keeps
an index on disk and changes it by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..schema import Bm25, Scoring, Search
from .merge import first_wins


@dataclass
class Index:
    """postings (field, term, id, tf), lengths (field, id, len), fields (field, avg_len, boost), total (n)."""

    postings: DataFrame
    lengths: DataFrame
    fields: DataFrame
    total: DataFrame

    def write(self, path: str) -> None:
        """Postings are kept by term, so a query's terms prune files by their ranges."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "fields", "total"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "fields", "total")))


class IndexStore:
    """An index on disk that is changed by document: postings and lengths are stores, the few totals follow from them."""

    def __init__(self, spark, root: str, settings: Bm25 = Bm25()):
        from ..sources.files import Store

        self.settings = settings
        self.postings = Store(spark, f"{root}/postings", "field string, term string, id string, tf bigint")
        self.lengths = Store(spark, f"{root}/lengths", "field string, id string, len bigint")

    def add(self, documents: DataFrame, key: str = "id") -> None:
        """Index further documents.  Ids that are there already have to be removed first."""
        fresh = build_index(documents, key, self.settings)
        self.postings.append(fresh.postings.select("field", "term", F.col("id").cast("string").alias("id"), "tf").repartitionByRange("term").sortWithinPartitions("term"))
        self.lengths.append(fresh.lengths.select("field", F.col("id").cast("string").alias("id"), "len"))

    def remove(self, ids: DataFrame) -> None:
        """Forget the documents with these (id)."""
        for store, order in ((self.postings, "term"), (self.lengths, "id")):
            kept = store.read().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_anti")
            store.write(kept.select(*store.read().columns).sortWithinPartitions(order))

    def clear(self) -> None:
        self.postings.clear()
        self.lengths.clear()

    def read(self) -> Index:
        lengths = self.lengths.read()
        boost = F.element_at(F.create_map(*(F.lit(x) for f, b in self.settings.boosts for x in (f, float(b)))), F.col("field"))
        fields = lengths.groupBy("field").agg((F.sum("len") / F.count("*")).alias("avg_len")).withColumn("boost", boost)
        return Index(self.postings.read(), lengths, fields, lengths.agg(F.count_distinct("id").alias("n")))

    def stats(self) -> DataFrame:
        """(document_count, indexed_fields)."""
        return self.lengths.read().agg(F.count_distinct("id").alias("document_count")).withColumn("indexed_fields", F.array(*(F.lit(f) for f, _ in self.settings.boosts)))


class VectorStore:
    """Vectors by id on disk: upsert, remove, clear, and semantic search where `enabled`; else it finds nothing."""

    def __init__(self, spark, root: str, enabled: bool = True):
        from ..sources.files import Store

        self.enabled = enabled
        self.vectors = Store(spark, f"{root}/vectors", "id string, v array<double>")

    def upsert(self, rows: DataFrame) -> None:
        new = rows.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v"))
        self.vectors.write(self.vectors.read().join(new.select("id"), "id", "left_anti").unionByName(first_wins(new, ["id"], ["v"])))

    def remove(self, ids: DataFrame) -> None:
        self.vectors.write(self.vectors.read().join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_anti"))

    def clear(self) -> int:
        return self.vectors.clear()

    def search(self, queries: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
        """(qid, id, score, rank) of a bounded set of (qid, qv)."""
        rows = self.vectors.read()
        return cosine_top_k(queries, rows if self.enabled else rows.limit(0), k, least)


def _field_text(name: str, kind: str) -> Column:
    return F.array_join(name, ",") if kind.startswith("array") else F.coalesce(F.col(name).cast("string"), F.lit(""))


def build_index(documents: DataFrame, key: str = "id", settings: Bm25 = Bm25()) -> Index:
    """Index the fields that have a boost; rows without a key are left out.  A field's length counts distinct terms."""
    kinds = dict(documents.dtypes)
    names = [(f, b) for f, b in settings.boosts if f in kinds]
    docs = documents.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    entries = F.array(*(F.struct(F.lit(f).alias("field"), E.tokens(_field_text(f, kinds[f])).alias("terms")) for f, _ in names))
    per = docs.select(F.col(key).alias("id"), F.explode(entries).alias("e")).select("id", "e.field", "e.terms")
    postings = per.select("field", F.explode("terms").alias("term"), "id").groupBy("field", "term", "id").agg(F.count("*").alias("tf"))
    lengths = per.select("field", "id", F.size(F.array_distinct("terms")).cast("bigint").alias("len"))
    boost = F.element_at(F.create_map(*(F.lit(x) for f, b in names for x in (f, float(b)))), F.col("field"))
    fields = lengths.groupBy("field").agg((F.sum("len") / F.count("*")).alias("avg_len")).withColumn("boost", boost)
    return Index(postings, lengths, fields, docs.agg(F.count("*").alias("n")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, qterm, n_terms) of (qid, query): distinct terms."""
    rows = queries.select("qid", F.array_distinct(E.tokens("query")).alias("terms"))
    return rows.select("qid", F.explode("terms").alias("qterm"), F.size("terms").alias("n_terms"))


def matching_terms(index: Index, terms: DataFrame, prefix: bool = True, fuzzy: bool = True, settings: Bm25 = Bm25()) -> DataFrame:
    """(qterm, term, weight): the vocabulary's terms for each query term, with the best of their weights.

    The vocabulary is small beside the postings, and query terms are few: they are sent to the vocabulary's tasks where Spark
    finds them small, else joined by first letter (prefixes) and by length (fuzzy terms differ by the distance at most).
    """
    vocabulary = index.postings.select("term").distinct().withColumn("size", F.length("term"))
    asked = terms.select("qterm").distinct().withColumn("qsize", F.length("qterm")).withColumn("far", E.half_up(F.length("qterm") * settings.fuzzy).cast("int"))
    out = vocabulary.join(asked, vocabulary["term"] == asked["qterm"]).select("qterm", "term", F.lit(1.0).alias("weight"))
    more = F.col("size") - F.col("qsize")
    if prefix:
        starts = asked.withColumn("head", F.substring("qterm", 1, 1))
        found = vocabulary.withColumn("first", F.substring("term", 1, 1)).join(starts, (F.col("first") == F.col("head")) & F.col("term").startswith(F.col("qterm")) & (more > 0))
        out = out.unionByName(found.select("qterm", "term", (F.lit(settings.prefix_weight) * F.col("size") / (F.col("size") + 0.3 * more)).alias("weight")))
    if fuzzy:
        sizes = asked.filter("far > 0").withColumn("near", F.explode(F.sequence(F.col("qsize") - F.col("far"), F.col("qsize") + F.col("far"))))
        found = vocabulary.join(sizes, F.col("size") == F.col("near")).withColumn("d", F.levenshtein("term", "qterm", 6))
        found = found.filter((F.col("d") > 0) & (F.col("d") <= F.col("far")))
        out = out.unionByName(found.select("qterm", "term", (F.lit(settings.fuzzy_weight) * F.col("size") / (F.col("size") + F.col("d"))).alias("weight")))
    # A term that a word both begins and nearly equals counts once, as its beginning.
    ranked = out.groupBy("qterm", "term").agg(F.max(F.when(F.col("term").startswith(F.col("qterm")), F.col("weight"))).alias("head"), F.max("weight").alias("any"))
    return ranked.select("qterm", "term", F.coalesce("head", "any").alias("weight"))


def bm25(index: Index, queries: DataFrame, prefix: bool = True, fuzzy: bool = True, settings: Bm25 = Bm25()) -> DataFrame:
    """(qid, id, score, matched): BM25+ over all fields, summed over terms, times the number of query terms matched."""
    terms = query_terms(queries)
    found = matching_terms(index, terms, prefix, fuzzy, settings)
    wanted = index.postings.join(found.select("term").distinct(), "term", "left_semi")
    frequency = wanted.groupBy("field", "term").agg(F.count("*").alias("df"))
    hits = wanted.join(frequency, ["field", "term"]).join(found, "term").join(terms.select("qid", "qterm"), "qterm")
    hits = hits.join(index.lengths, ["field", "id"]).join(F.broadcast(index.fields), "field").crossJoin(F.broadcast(index.total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = settings.k * (1 - settings.b + settings.b * F.col("len") / F.col("avg_len"))
    score = F.col("weight") * F.col("boost") * idf * (settings.d + F.col("tf") * (settings.k + 1) / (F.col("tf") + norm))
    per = hits.withColumn("s", score).groupBy("qid", "id").agg(F.sum("s").alias("sum"), F.count_distinct("qterm").alias("matched"))
    # Sums come in any order: to 9 places reruns agree, and equal scores tie.
    return per.select("qid", "id", E.decimals(F.col("sum") * F.col("matched"), 9).alias("score"), "matched")


def top(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query (ranks before the shuffle too)."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def structural_score(query: Column, w: Scoring = Scoring(), name="name", route="route", file="file", tags="tags", text="text") -> Column:
    """How a signal's name, route, file, tags and text meet a query's words."""
    q = F.lower(query)
    terms = F.split(q, r"\s+")
    has = lambda c, t: F.contains(c, t)
    total = lambda f: F.aggregate(terms, F.lit(0.0), lambda a, t: a + f(t))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    n, out = F.lower(E.col(name)), F.lit(0.0)
    named = F.when(n == q, w.name * 2).when(has(n, q), w.name).otherwise(total(lambda t: F.when(has(n, t), w.name * 0.5).otherwise(0.0)))
    out = F.when(given(E.col(name)), named).otherwise(0.0)
    if route is not None:
        path, method = F.lower(E.col(route)["path"]), F.lower(E.col(route)["method"])
        on_path = F.when(has(q, path), w.route_path).otherwise(total(lambda t: F.when(has(path, t), w.route_path * 0.3).otherwise(0.0)))
        out = out + F.when(given(path), on_path).otherwise(0.0) + F.when(given(method) & has(q, method), w.route_method * 0.5).otherwise(0.0)
    base = F.lower(E.basename(E.col(file)))
    on_file = F.when(given(base) & has(q, base), w.file).otherwise(0.0) + total(lambda t: F.when(has(base, t), w.file * 0.3).otherwise(0.0))
    out = out + F.when(given(E.col(file)), on_file).otherwise(0.0)
    if tags is not None:
        one = lambda g: total(lambda t: F.when(g == t, w.tags * 0.5).when(has(g, t), w.tags * 0.2).otherwise(0.0))
        out = out + F.coalesce(F.aggregate(F.transform(E.col(tags), lambda g: one(F.lower(g))), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    t = F.lower(E.col(text))
    return out + F.when(given(E.col(text)), total(lambda x: F.when(has(t, x), w.text * 0.3).otherwise(0.0))).otherwise(0.0)


def score_and_sort(signals: DataFrame, queries: DataFrame, w: Scoring = Scoring(), tie: str = "id", limit: int | None = None, **columns) -> DataFrame:
    """All (qid, signal) with a structural score of min_score or more, ranked; with a limit the best of them, which are ranked
    before the shuffle too.  The queries are a bounded set that is sent to the signals' tasks."""
    scored = signals.crossJoin(queries).withColumn("score", structural_score(F.col("query"), w, **columns)).filter(F.col("score") >= w.min_score)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(tie).asc())))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def normalised(rows: DataFrame, by: str = "qid", score: str = "score", floor: float | None = 0.001) -> DataFrame:
    """Scores divided by the query's largest, to 2 places; without a floor nothing changes where the largest is 0.

    The largest is aggregated and joined back, one row a query, so one query's rows needn't meet in one task.
    """
    most = rows.groupBy(F.col(by).alias("_by")).agg(F.max(score).alias("_most"))
    joined = rows.join(most, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    divided = E.decimals(F.col(score) / (F.greatest(F.col("_most"), F.lit(floor)) if floor else F.col("_most")))
    return joined.withColumn(score, divided if floor else F.when(F.col("_most") == 0, F.col(score)).otherwise(divided)).drop("_most")


def post_filter(rows: DataFrame, kind: str | None = None, framework: str | None = None, file: str | None = None) -> DataFrame:
    """By kind, framework, and a part of the path in any case; null files never match."""
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if framework:
        rows = rows.filter(F.col("framework") == framework)
    if file:
        rows = rows.filter(F.contains(F.lower(E.slashes("file")), F.lit(file.lower().replace("\\", "/"))))
    return rows


def hybrid_search(signals: DataFrame, queries: DataFrame, settings: Search = Search(), kind: str | None = None, framework: str | None = None, file: str | None = None, candidate_mode: str = "pre", resort: bool = True, index: Index | None = None, key: str = "id", prefix: bool = True, fuzzy: bool = True, weights: Bm25 = Bm25(), dedup: str = "before") -> DataFrame:
    """(qid, rank, score, signal columns): candidates by the index, rescored with the structural score, best first.

    candidate_mode "pre" filters before the candidates are cut to candidate_factor * limit, "post" after, which can
    leave too few.  resort=False keeps the index's order.  Equal results (five-part key) show once: with dedup "before" the
    limit counts different results, with "after" equal ones use it up.  See search_as_reference for the other defaults.
    """
    rows = signals.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    index = index or build_index(rows, key, weights)
    scored = bm25(index, queries, prefix, fuzzy, weights)
    if candidate_mode == "pre" and (kind or framework or file):
        scored = scored.join(post_filter(rows, kind, framework, file).select(F.col(key).alias("id")), "id", "left_semi")
    best = top(scored, settings.candidate_factor * settings.limit).select("qid", F.col("id").alias("_id"), E.decimals(F.col("score")).alias("bm25"), F.col("rank").alias("bm25_rank"))
    found = rows.join(best, rows[key] == best["_id"]).drop("_id").join(F.broadcast(queries.select("qid", "query")), "qid")
    if candidate_mode == "post":
        found = post_filter(found, kind, framework, file)
    combined = E.decimals(settings.bm25_weight * F.col("bm25") + settings.scoring_weight * structural_score(F.col("query"), route="route" if "route" in signals.columns else None))
    found = normalised(found.withColumn("score", combined)).filter(F.col("score") >= settings.min_score)
    order = [F.col("score").desc(), F.col("bm25_rank").asc()] if resort else [F.col("bm25_rank").asc()]
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    if dedup == "after":
        found = ranked(found).filter(F.col("rank") <= settings.limit)
    once = first_wins(found, ["qid", E.line_key().alias("k")], order)
    return ranked(once).filter(F.col("rank") <= settings.limit).drop("query")


def search_as_reference(signals: DataFrame, queries: DataFrame, settings: Search = Search(), **options) -> DataFrame:
    """hybrid_search in the index's order, with filters after the cut, and equal results counted by the limit; files with forward slashes."""
    found = hybrid_search(signals, queries, settings, **({"candidate_mode": "post", "resort": False, "dedup": "after"} | options))
    return found.withColumn("file", E.slashes("file"))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """(qid, id, score, rank): (qid, qv) against (id, v).  Queries are a bounded set; rows without a vector don't match."""
    scored = vectors.filter("v is not null").crossJoin(queries).withColumn("score", cosine(F.col("qv"), F.col("v"))).select("qid", "id", "score")
    return top(scored if least is None else scored.filter(F.col("score") >= least), k)


def _block_cosines(k: int, places: int):
    """A block of vectors and one of queries: each query's best k by rounded cosine, then id."""

    def pair(some: pa.Table, wanted: pa.Table) -> pa.Table:
        vectors, queries = ([(r[0], np.array(r[1], np.float64)) for r in zip(x.column("id").to_pylist(), x.column("v").to_pylist(), strict=True)] for x in (some, wanted))
        ids, scale = np.array([i for i, _ in vectors], np.int64), 10**places
        norm = lambda m: np.sqrt(np.cumsum(m * m, 1)[:, -1]) if m.shape[1] else np.zeros(len(m))
        sizes, found = np.array([len(v) for _, v in vectors], np.int64), []
        for d in {len(v) for _, v in queries} if vectors else ():
            same = np.flatnonzero(sizes == d)
            m, asked = np.array([vectors[j][1] for j in same]).reshape(len(same), d), [q for q in queries if len(q[1]) == d]
            norms = norm(m)
            for qid, q in asked:
                # Matrix sums choose, sums in order of the components decide; other lengths and zero vectors score 0.
                both, near = norms * norm(q[None])[0], np.zeros(len(ids))
                near[same] = np.divide(m @ q, both, out=np.zeros(len(same)), where=both != 0)
                least = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
                at = np.flatnonzero(near >= least - 2 / scale)
                exact, place = np.zeros(len(at)), np.searchsorted(same, at)
                inside = np.isin(at, same)
                rows = place[inside]
                if len(rows) and d:
                    dots = np.cumsum(m[rows] * q, 1)[:, -1]
                    exact[inside] = np.divide(dots, both[rows], out=np.zeros(len(rows)), where=both[rows] != 0)
                exact = np.floor(exact * scale + 0.5) / scale
                best = np.lexsort((ids[at], -exact))[:k]
                found += [(qid, int(ids[at[j]]), float(exact[j])) for j in best]
        return pa.table([pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["qid", "id", "score"])

    return pair


def cosine_top_k_blocks(queries: DataFrame, vectors: DataFrame, k: int = 10, places: int = 6, candidate_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(qid, id, score, rank): bigint (qid, qv) against bigint (id, v), neither side bounded, cut into blocks by a hash.

    Scores are rounded before they are ranked, ties go to the smaller id.  Vectors that are null or hold null or
    non-finite components take no part.
    """
    good = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.select("id", F.col("v").cast("array<double>").alias("v")).filter(good("v"))
    queries = queries.select(F.col("qid").alias("id"), F.col("qv").cast("array<double>").alias("v")).filter(good("v"))
    n, m = max(1, -(-vectors.count() // candidate_block)), max(1, -(-queries.count() // query_block))
    spot = F.xxhash64("id")
    vectors = vectors.withColumn("block", F.pmod(spot, F.lit(n)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    queries = queries.withColumn("part", F.pmod(spot, F.lit(m)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    best = vectors.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(_block_cosines(k, places), "qid bigint, id bigint, score double")
    return top(best, k)


def cosine_means(queries: DataFrame, vectors: DataFrame, by: str) -> DataFrame:
    """(qid, by, n, score): the mean cosine of each (qid, qv) with the rows (by, v), by way of each group's sum of unit vectors."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: F.transform(c, lambda x: F.when(length(c) > 0, x / length(c)).otherwise(0.0))
    rows = vectors.select(by, F.col("v").cast("array<double>").alias("v"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.count("v").alias("with_v"))
    parts = rows.select(by, F.size("v").alias("d"), F.posexplode(unit(F.col("v")))).groupBy(by, "d", "pos").agg(F.sum("col").alias("x"))
    sums = parts.groupBy(by, "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"))
    asked = queries.select("qid", F.col("qv").cast("array<double>").alias("qv")).select("qid", unit(F.col("qv")).alias("qv"))
    pairs = asked.withColumn("d", F.size("qv")).crossJoin(sizes.withColumnRenamed(by, "g"))
    dot = F.aggregate(F.zip_with("qv", "total", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    found = pairs.join(sums, sums[by].eqNullSafe(pairs["g"]) & (sums["d"] == pairs["d"]), "left")
    return found.select("qid", F.col("g").alias(by), "n", F.when(F.col("with_v") > 0, F.coalesce(dot, F.lit(0.0)) / F.col("with_v")).alias("score"))


def text_hash(text: Column) -> Column:
    """31 h + code of each character in 32-bit arithmetic, without sign."""
    wrap = lambda x: ((x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    return F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: wrap(h * 31 + F.ascii(c))))


def hash_embedding(text: Column, size: int = 128) -> Column:
    """The toy embedding: seeded sines of the text's hash, of length 1.  Equal texts are equal, nothing else is near."""
    # Each stage's value is bound by a lambda over a one-element array, so it is computed once, not for every component.
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    part = lambda x: x - F.floor(x)
    raw = lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: once(F.sin((h + i).cast("double")) * 10000, part))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return once(text_hash(text), lambda h: once(raw(h), unit))


def signal_text(name="name", text="text", tags="tags") -> Column:
    return E.trim_all(F.concat_ws(" ", F.coalesce(E.col(name), F.lit("")), E.col(text), F.array_join(E.col(tags), " ")))
