import collections
import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle import queries as core
from brindle import schema
from brindle.functions import exprs as E
from brindle.operators import code, lines, merge, retrieval, stats, syntax
from brindle.plans import evaluate
from brindle.plans.engine import Engine
from brindle.plans.journal import Journal
from brindle.schema import Search
from brindle.sources import files as S

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    frame = core.QUERIES[name](spark, DATA)
    names = sorted(frame.columns)
    got = collections.Counter(tuple(str(r[c]) for c in names) for r in frame.collect())
    found = duck.execute(core.ORACLE_SQL[name])
    there = [d[0] for d in found.description]
    assert sorted(there) == names
    assert got == collections.Counter(tuple(str(r[there.index(c)]) for c in names) for r in found.fetchall())


def ev(spark, tool, output):
    return spark.createDataFrame([("e", "s", tool, "", output, None)], "id string, session_id string, tool string, input string, output string, created_at timestamp")


def read(spark, *text):
    body = "\n".join(f"{i}: {x}" for i, x in enumerate(text, 1))
    return ev(spark, "read", f"<path>/src/app.py</path>\n<content>\n{body}\n</content>")


@pytest.mark.parametrize(
    "line",
    ["throw new HttpError('gone')", "print(len(rows))", "with open('a.txt') as f:", "return new UploadReply()", "console.log('x')", "return reply.json({ ok: true })", "rows.map(x => x.id)", "rows.forEach(console.log)", "const n = parseInt('7')", "const o = JSON.parse(s)", "const e = require('e')", "const h = new Handler()"],
)
def test_calls_are_no_functions(spark, line):
    assert not lines.read_signals(read(spark, line)).filter("kind = 'function'").collect()


@pytest.mark.parametrize(
    ("line", "kind", "name"),
    [
        ("def load(path):", "function", "load"), ("function run(a) {", "function", "run"), ("const f = (a) => a", "function", "f"), ("const g = async x => x", "function", "g"), ("func Serve(w) {", "function", "Serve"),
        ("class User:", "class", "User"), ("export class Api {", "class", "Api"), ("interface Shape {", "class", "Shape"), ("type Id = string", "class", "Id"), ("@app.get(\"/x\")", "route", "GET /x"), ("router.post('/y', h)", "route", "POST /y"), ("@Get()", "route", "GET "),
        ("import os", "import", None), ("from a.b import c", "import", None), ("const x = require('y')", "import", None),
    ],
)
def test_lines(spark, line, kind, name):
    got = [(r["kind"], r["name"]) for r in lines.read_signals(read(spark, line)).filter("kind <> 'file_read'").collect()]
    assert (kind, name) in got


def test_lines_without_anything(spark):
    assert lines.signals(ev(spark, "read", "")).count() == 0
    assert lines.signals(ev(spark, "other", "x")).count() == 0
    assert [r["kind"] for r in lines.signals(ev(spark, "lsp", "plain")).collect()] == ["lsp_result"]




@pytest.mark.parametrize(("before", "after", "percent"), [(50000, 8000, 84), (10000, 12000, -20), (3750, 700, 81), (1000, 850, 15), (0, 5, 0)])
def test_reduction(spark, before, after, percent):
    assert spark.range(1).select(E.reduction(F.lit(before), F.lit(after))).first()[0] == percent


def test_break_even(spark):
    assert spark.range(1).select(E.break_even(F.lit(50000), F.lit(100)), E.break_even(F.lit(5), F.lit(0))).first()[:] == (500, 999)


def test_rounding(spark):
    assert spark.range(1).select(E.half_up(F.lit(-2.5)), E.half_up(F.lit(2.5))).first()[:] == (-2, 3)


SIGNALS = [
    ("1", "function", "authenticateUser", "src/auth.ts", "function authenticateUser(...)", ["function", "authenticateUser"], None),
    ("2", "class", "UserService", "src/user.ts", "class UserService", ["class", "UserService"], None),
    ("3", "route", "POST /login", "src/auth.ts", "POST /login", ["route", "POST", "/login"], ("POST", "/login", None)),
    ("4", "import", None, "src/app.ts", "import express from 'express'", ["import", "express"], None),
    ("5", "function", "connectDatabase", "src/db.ts", "function connectDatabase(...)", ["function", "connectDatabase"], None),
    ("6", "function", "login", "src/auth.ts", "function login(...)", ["function", "login"], None),
    ("", "function", "ghost", "src/x.ts", "function ghost(...)", ["function"], None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(SIGNALS, "id string, kind string, name string, file string, text string, tags array<string>, route struct<method:string,path:string,handler:string>")
    return rows.withColumn("language", F.lit("typescript")).withColumn("framework", F.lit(None).cast("string")).withColumn("line_start", F.lit(1)).cache()


def find(spark, corpus, text, **kw):
    asked = spark.createDataFrame([("q", text)], "qid string, query string")
    return [r["name"] for r in retrieval.hybrid_search(corpus, asked, Search(), **kw).orderBy("rank").collect()]


def test_search_ranks_the_exact_name_first(spark, corpus):
    assert find(spark, corpus, "login")[0] == "login"


def test_search_prefix_and_typo(spark, corpus):
    assert "authenticateUser" in find(spark, corpus, "authenticate")
    assert "connectDatabase" in find(spark, corpus, "conectDatabase")


def test_search_filters(spark, corpus):
    assert find(spark, corpus, "login", kind="route") == ["POST /login"]
    assert find(spark, corpus, "user", file="USER.ts") == ["UserService"]
    assert find(spark, corpus, "login", kind="route", candidate_mode="post") == ["POST /login"]


def test_search_nothing(spark, corpus):
    assert find(spark, corpus, "zzzzqqq") == []
    assert find(spark, corpus, "!!! ???") == []
    assert "ghost" not in find(spark, corpus, "ghost")
    assert isinstance(find(spark, corpus, "x" * 1000), list)


def test_index_round_trip(spark, corpus, tmp_path):
    asked = spark.createDataFrame([("q", "login")], "qid string, query string")
    index = retrieval.build_index(corpus)
    index.write(str(tmp_path))
    again = retrieval.Index.read(spark, str(tmp_path))
    key = lambda i: sorted((r["id"], round(r["score"], 9)) for r in retrieval.bm25(i, asked).collect())
    assert key(index) == key(again) != []


def test_equal_texts_embed_equally(spark):
    a, b = spark.range(1).select(retrieval.hash_embedding(F.lit("abc")), retrieval.hash_embedding(F.lit("abc"))).first()
    assert a == b and len(a) == 128 and abs(sum(x * x for x in a) - 1) < 1e-9


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert spark.range(1).select(retrieval.cosine(v(1.0, 0.0), v(2.0, 0.0)), retrieval.cosine(v(0.0, 0.0), v(1.0, 0.0)), retrieval.cosine(v(1.0), v(1.0, 0.0))).first()[:] == (1.0, 0.0, 0.0)


@pytest.mark.parametrize("name", ["cosine_topk_every50", "cosine_by_label_every50"])
def test_every_50th_vector_is_searched(spark, name):
    assert {r["qid"] for r in core.QUERIES[name](spark, DATA).collect()} == {str(i) for i in range(0, 500, 50)}


@pytest.mark.parametrize("n", [50, 100])
def test_heads_have_the_reference_s_lines(spark, tmp_path, n):
    spark.createDataFrame([(1, "\n".join(["ab"] * 120)), (2, "abc")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in core.QUERIES[f"head_chars_{n}"](spark, str(tmp_path)).collect()} == {(1, 3 * n - 1), (2, 3)}


def test_cosine_blocks_equal_the_cross_join(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 5 if i % 9 else 4)] if i % 11 else [0.0] * 4) for i in range(120)] + [(500, None)]
    v = spark.createDataFrame(rows, "id bigint, v array<double>")
    q = v.filter("id % 10 = 0").selectExpr("id qid", "v qv")
    plain = v.filter("v is not null").crossJoin(q.filter("qv is not null")).withColumn("score", F.floor(retrieval.cosine(F.col("qv"), F.col("v")) * 1000000 + 0.5) / 1000000)
    want = sorted(tuple(r) for r in retrieval.top(plain.select("qid", "id", "score"), 10).collect())
    assert sorted(tuple(r) for r in retrieval.cosine_top_k_blocks(q, v, 10, candidate_block=16, query_block=5).collect()) == want


TS = """import a, { b as c } from 'x'
export * as ns from 'y'
@Injectable()
export abstract class Foo<T> extends Base<T> implements I {
  static count = 0
  constructor(private a: string) { super() }
  async get(id: string): Promise<void> { return this.x.get('/p', 1) }
  get value(): number { return 1 }
}
const enum Color { Red }
namespace N { export function inner() {} }
const f = async (x: number) => { const s = `a ${x + `${x}`} {`; return /re[/]x{/.test(s) }
// function ghost() {}
const s = "function ghost2() {}"
app.get('/users/:id', show)
fastify.route({ method: 'POST', url: '/items', handler: make })
"""


def test_structure(spark):
    got = {(s["kind"], s["name"], s["text"]) for s in syntax.extract(TS, "a.ts", "typescript", ["express", "fastify"], "/api", "/api")}
    for want in [
        ("import", None, "import { c } from 'x'"), ("export", "ns", "export namespace ns"), ("function", "Injectable", "@Injectable(...)"), ("class", "Foo", "class Foo extends Base, I"), ("class", "count", "static count"), ("function", "get", "async get(...)"),
        ("function", "value", "get value"), ("class", "Color", "const enum Color"), ("class", "N", "namespace N"), ("function", "inner", "function inner(...)"), ("function", "f", "const f = async (...) => ..."), ("route", "GET /users/:id", "GET /users/:id"), ("route", "POST /items", "POST /items"),
    ]:
        assert want in got, want
    assert not [x for x in got if "ghost" in str(x) or x[1] == "constructor"]


@pytest.mark.parametrize("text", ["", "{{{{", "`${", "'", "/*", "class", "import", "export default", "const = =>", "@", "function (", "interface X {", "a." * 500, "(" * 500])
def test_structure_of_broken_sources(text):
    syntax.extract(text, "a.ts", "typescript", ["express", "fastify", "nextjs", "react"], "/api", "/api")


def test_plan_and_merge(spark):
    t0, t1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    ddl = "path string, mtime timestamp, hash string"
    old = spark.createDataFrame([("same", t0, "a"), ("touched", t0, "b"), ("edited", t0, "c"), ("gone", t0, "d")], ddl)
    new = spark.createDataFrame([("same", t0, "z"), ("touched", t1, "b"), ("edited", t1, "x"), ("fresh", t1, "y")], ddl)
    assert dict(merge.incremental_plan(new, old).collect()) == {"same": "unchanged", "touched": "unchanged", "edited": "changed", "fresh": "new", "gone": "removed"}
    assert dict(merge.incremental_plan(new, old, verify_hash=True).collect())["same"] == "changed"
    assert "removed" not in dict(merge.incremental_plan(new, old, force=True).collect()).values()


def test_empty_log(spark):
    assert stats.search_stats(spark.createDataFrame([], "query string, results_count int, ts timestamp")).first()[:] == (0, 0.0, 0, 0)


def test_real_baseline_and_report(spark):
    e = ("function", None, None, "auth", "login", True)
    q = spark.createDataFrame([("a", "find login function", "navigation", e)], "id string, query string, category string, expected struct<kind:string,method:string,path:string,file:string,handler:string,lineRequired:boolean>")
    f = spark.createDataFrame([("src/auth/login.ts", "export function login() {}", 0)], "path string, content string, ordinal int")
    r = evaluate.real_baseline(q, f).first()
    assert r["correctness"] == 3.0 and r["full_reads"] == 1
    m, text = evaluate.benchmark_suite(q, spark.createDataFrame([("function", "login", "src/auth/login.ts", 1, "export function login", 0)], "kind string, name string, file string, line int, text string, pos int"), f)
    assert m.count() == 6 and "Verdict" in text


def test_engine_end_to_end(spark, tmp_path):
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    (tree / "src").mkdir(parents=True)
    (tree / "node_modules").mkdir()
    (tree / "src" / "auth.ts").write_text("export function login(a) {}\napp.post('/login', login)\n")
    (tree / "src" / "main.py").write_text("import os\ndef start(x):\n    pass\n")
    (tree / "node_modules" / "x.ts").write_text("export function hidden() {}\n")
    engine = Engine(spark, store)
    first = engine.scan(str(tree))
    assert (first["scanned"], first["to_index"]) == (2, 2)
    assert {r["name"] for r in engine.signals.read().collect()} >= {"login", "POST /login", "start"}
    assert engine.scan(str(tree))["to_index"] == 0
    (tree / "src" / "main.py").unlink()
    (tree / "src" / "auth.ts").write_text("export function logout(a) {}\n")
    os.utime(tree / "src" / "auth.ts", (2_000_000_000, 2_000_000_000))
    again = engine.scan(str(tree))
    assert (again["to_index"], again["removed"]) == (1, 1)
    assert {r["name"] for r in engine.signals.read().collect()} == {"logout"}
    out = ev(spark, "glob", "Found 1\n/a/b.ts\n")
    evidence = engine.evidence.read().count()
    assert engine.ingest(out) == {"created": 1, "updated": 0} and engine.ingest(out) == {"created": 0, "updated": 1}
    assert engine.evidence.read().count() == evidence + 1 and engine.index.stats().first()["document_count"] == 2
    assert engine.search("logout").first()["name"] == "logout"
    assert engine.stats().first()["total_searches"] == 1
    assert engine.kinds().count() == 12
    assert engine.clear()["signals"] == 2 and engine.signals.read().count() == 0


def test_warm_start_counters_and_fallback(spark, tmp_path, monkeypatch):
    tree = tmp_path / "it's src" / "lib" / "src"
    (tree / "dist").mkdir(parents=True)
    (tree / "dist" / "a.ts").write_text("export function hidden() {}\n")
    (tree / "good.ts").write_text("export function fine() {}\n")
    (tree / "big.ts").write_text("x" * 5000)
    root = str(tmp_path / "it's src")
    engine = Engine(spark, str(tmp_path / "store"))
    small = schema.ScanRules(max_bytes=1000)
    assert engine.warm(root, small) == {"state": "indexed", "changed": 1, "removed": 0}
    assert [r["file"] for r in engine.signals.read().collect()] == ["lib/src/good.ts"]
    assert engine.warm(root, small) == {"state": "warm", "changed": 0, "removed": 0}
    (tree / "bad.ts").write_text("export class Late {}\napp.get('/late', late)\n")
    assert engine.warm(root, small) == {"state": "stale", "changed": 1, "removed": 0}
    # The scanner fails on a file: its signals come by patterns.
    real = syntax.structural_signals
    broken = lambda rows: real(rows).withColumn("kind", F.when(F.col("file").contains("bad"), "error").otherwise(F.col("kind")))
    monkeypatch.setattr("brindle.plans.engine.syntax.structural_signals", broken)
    done = engine.scan(root, rules=small)
    assert (done["failed"] > 0, done["skipped"], done["to_index"]) == (True, 1, 1) and done["errors"] and done["duration_ms"] > 0
    assert {r["name"] for r in engine.signals.read().collect()} >= {"fine", "Late", "GET /late"}
    report = engine.evaluate(root, spark.createDataFrame([("1", "where is fine", "symbol", ("function", None, None, None, "fine", False))], "id string, query string, category string, expected struct<kind:string,method:string,path:string,file:string,handler:string,lineRequired:boolean>"), small)
    assert report[0].count() == 6 and "Verdict" in report[1]


def test_store_appends_compacts_and_forgets(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"), "a int", keep=2)
    store.COMPACT = 3
    one = lambda i: spark.createDataFrame([(i,)], "a int")
    for i in range(6):
        store.append(one(i))
    assert sorted(r["a"] for r in store.read().collect()) == list(range(6))
    names = os.listdir(tmp_path / "s")
    assert len([n for n in names if n.startswith("m")]) == 2 and len([n for n in names if n.startswith("d")]) <= 5
    with pytest.raises(Exception, match="exist"):
        store._commit(one(9), [], store.version())
    assert store.clear() == 6 and store.read().count() == 0


def test_search_log_keeps_the_last_searches(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.log.write(spark.range(1000).selectExpr("'old' as query", "0 as results_count", "timestamp_seconds(id) as ts"))
    engine.search("anything")
    assert engine.log.read().count() == 500 and engine.log.read().filter("query = 'anything'").count() == 1


def test_journal_keeps_levels_and_averages_by_mode(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"), most=3)
    assert journal.metrics().first()["total_queries"] == 0
    journal.log("debug", "left out")
    journal.log("warn", "slow", file="a.ts")
    journal.query("x", "signals", 100, 2)
    journal.query("x", "baseline", 4100, 1)  # the third entry that counts: all are written
    assert journal.store.read().count() == 3 and journal.entries("warn").first()["details"] == {"file": "a.ts"}
    one = journal.metrics().first()
    assert (one["total_queries"], one["avg_signal_chars"], one["avg_baseline_chars"], one["reduction_percent"], one["break_even"]) == (2, 100, 4100, 98, 3)
    with pytest.raises(ValueError):
        journal.log("loud", "no such level")
    assert journal.clear() == 3 and journal.entries().count() == 0


def test_index_and_vectors_follow_their_documents(spark, tmp_path):
    store = retrieval.IndexStore(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([("1", "red bolt", "a"), ("2", "red ring", "b"), ("3", "blue ring", "c")], "id string, text string, name string")
    store.add(docs.filter("id < 3"))
    store.add(docs.filter("id = 3"))
    asked = spark.createDataFrame([("q", "ring")], "qid string, query string")
    found = lambda index: sorted((r["id"], round(r["score"], 9)) for r in retrieval.bm25(index, asked).collect())
    assert found(store.read()) == found(retrieval.build_index(docs)) and len(found(store.read())) == 2
    store.remove(docs.filter("id = 2").select("id"))
    assert found(store.read()) == found(retrieval.build_index(docs.filter("id <> 2"))) and store.stats().first()["document_count"] == 2
    store.clear()
    assert found(store.read()) == []
    vectors = retrieval.VectorStore(spark, str(tmp_path / "v"))
    vectors.upsert(spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, v array<double>"))
    vectors.upsert(spark.createDataFrame([("2", [1.0, 1.0])], "id string, v array<double>"))
    q = spark.createDataFrame([("q", [1.0, 1.0])], "qid string, qv array<double>")
    assert [r["id"] for r in vectors.search(q, 1).collect()] == ["2"]
    vectors.remove(spark.createDataFrame([("2",)], "id string"))
    assert [r["id"] for r in vectors.search(q).collect()] == ["1"]
    vectors.enabled = False
    assert vectors.search(q).count() == 0 and vectors.clear() == 1


def test_marks_in_sources_do_not_matter(spark):
    rows = spark.createDataFrame([("a.ts", "// \ue0f1\n\nfunction one() {}\nfunction two() {}\n")], "file string, content string")
    assert sorted((r["name"], r["line_start"]) for r in code.fallback_signals(rows).collect()) == [("one", 3), ("two", 4)]


def test_stream(spark, tmp_path):
    from brindle.streaming.ingest import ingest_stream, tool_output_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": "1", "session_id": "s", "tool": "glob", "output": "/x/y.ts"}\n')
    engine = Engine(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(tool_output_stream(spark, str(folder)), engine, str(tmp_path / "ck")).awaitTermination()
    assert [r["file"] for r in engine.signals.read().collect()] == ["/x/y.ts"] and engine.evidence.read().count() == 1
