"""Signals from whole source files by patterns, in built-in expressions only.

A pattern's matches are found with their lines by putting a mark before each match and splitting there: the parts
before a match give its line, the part itself its groups.  All rules of an extractor become one array column that is
exploded once, so a file is read once however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules
from .merge import first_wins

#: Marks matches; where a source holds it, it is taken out first: it is no character of any program.
MARK = "\ue0f1"


def matches(content: Column, pattern: str, groups: int = 1) -> Column:
    """Array of (line, all, g1 .. gn) of every match; groups that took no part are empty."""
    marked = F.regexp_replace(F.replace(content, F.lit(MARK), F.lit("")), pattern, MARK + "$0")
    inline = pattern.startswith("(?")
    flags = pattern[: pattern.index(")") + 1] if inline and pattern[2] in "im" and pattern[3] == ")" else ""
    anchored = flags + r"\A(?:" + pattern[len(flags) :] + ")"
    marks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(MARK), F.lit("")))
    # A line's number as often as it holds a mark: linear in the text, however many matches there are.
    lines = F.flatten(F.transform(F.split(marked, "\n"), lambda t, i: F.array_repeat(i + 1, marks(t))))
    parts = F.split(marked, MARK)
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def found(p: Column, line: Column) -> Column:
        return F.struct(line.alias("line"), F.regexp_extract(p, anchored, 0).alias("all"), *(F.regexp_extract(p, anchored, g).alias(f"g{g}") for g in range(1, groups + 1)))

    return F.zip_with(parts, lines, found)


def _as_signals(found: Column, rule: int, kind: str, text, name=None, tags=(), confidence: float = 0.9, framework: str | None = None, route=None, keep=None) -> Column:
    """Matches as signal structs; text, name, tags and route are functions of a match."""
    if keep is not None:
        found = F.filter(found, keep)
    none = F.lit(None).cast("string")

    def one(m: Column, i: Column) -> Column:
        method, path = route(m) if route else (none, none)
        return F.struct(
            F.lit(rule).alias("rule"),
            i.alias("nth"),
            F.lit(kind).alias("kind"),
            (name(m) if name else none).alias("name"),
            text(m).alias("text"),
            E.tag_set(E.strings(*(t(m) if callable(t) else t for t in tags))).alias("tags"),
            F.lit(confidence).alias("confidence"),
            F.lit(framework).cast("string").alias("framework"),
            method.alias("method"),
            path.alias("path"),
            m["line"].cast("int").alias("line_start"),
        )

    return F.transform(found, one)


def _spread(sources: DataFrame, arrays: list[Column], language: Column, dedup: bool = True) -> DataFrame:
    """(file, signal columns) of all rules; equal ones by the five-part key once."""
    rows = sources.select("file", language.alias("language"), F.explode(F.concat(*arrays)).alias("s")).select("file", "language", "s.*")
    rows = rows.withColumn("emit_pos", F.struct("rule", "nth")).drop("rule", "nth")
    if dedup:
        rows = first_wins(rows, ["file", E.line_key().alias("k")], ["emit_pos"])
    return rows


def _template(t: str):
    """A text with {0} for the match's first group."""
    head, _, tail = t.partition("{0}")
    return lambda m: F.concat(F.lit(head), m["g1"], F.lit(tail)) if "{0}" in t else F.lit(t)


def _not_builtin(m: Column) -> Column:
    return ~m["g1"].isin(*rules.BUILTINS)


def _route_array(content: Column, rule: int, pattern: str, framework: str, confidence: float = 0.85) -> Column:
    return _as_signals(
        matches(content, pattern, 2), rule, "route",
        text=lambda m: F.concat_ws(" ", F.upper(m["g1"]), m["g2"]), name=lambda m: F.concat_ws(" ", F.upper(m["g1"]), m["g2"]),
        tags=("route", lambda m: F.upper(m["g1"]), lambda m: m["g2"], framework), confidence=confidence, framework=framework, route=lambda m: (F.upper(m["g1"]), m["g2"]),
    )


def fallback_signals(sources: DataFrame, routes: bool = True, components: bool = True) -> DataFrame:
    """Imports, exports, declarations, routes and components of (file, content) rows."""
    c = F.col("content")
    arrays = [
        _as_signals(matches(c, rules.SOURCE_IMPORT), 0, "import", text=lambda m: F.concat(F.lit("import from '"), m["g1"], F.lit("'")), tags=("import", lambda m: m["g1"])),
        _as_signals(matches(c, rules.SOURCE_EXPORT), 1, "export", text=lambda m: m["all"], tags=("export",)),
    ]
    for i, (kind, pattern, text, tags, confidence) in enumerate(rules.SOURCE_RULES, 2):
        keep = _not_builtin if kind == "function" else None
        arrays.append(_as_signals(matches(c, pattern), i, kind, text=_template(text), name=lambda m: m["g1"], tags=tuple(_template(t) if "{0}" in t else t for t in tags), confidence=confidence, keep=keep))
    if routes:
        arrays += [_route_array(c, 20, rules.EXPRESS_ROUTE, "express"), _route_array(c, 21, rules.FASTIFY_ROUTE, "fastify")]
    if components:
        jsx = F.col("file").rlike(r"\.(tsx|jsx)$")
        keep = lambda m: E.is_component(m["g1"], rules.BUILTINS)
        found = _as_signals(matches(c, rules.FALLBACK_COMPONENT), 22, "component", text=_template("Component {0}"), name=lambda m: m["g1"], tags=("component", lambda m: m["g1"], "react"), confidence=0.85, framework="react", keep=keep)
        arrays.append(F.when(jsx, found).otherwise(F.slice(found, 1, 0)))
    return _spread(sources, arrays, E.fallback_language("file"))


def express_routes(sources: DataFrame) -> DataFrame:
    """Calls on app or router, and decorators with a path."""
    c = F.col("content")
    return _spread(sources, [_route_array(c, 0, rules.EXPRESS_ROUTE, "express"), _route_array(c, 1, rules.DECORATOR_ROUTE, "express")], F.lit("typescript"), dedup=False)


def fastify_routes(sources: DataFrame) -> DataFrame:
    return _spread(sources, [_route_array(F.col("content"), 0, rules.FASTIFY_ROUTE, "fastify")], F.lit("typescript"), dedup=False)


def next_routes(sources: DataFrame) -> DataFrame:
    """Exported functions named as HTTP verbs, by the router that the file's place tells."""
    file, c = E.slashes("file"), F.col("content")
    app = file.rlike(r"(^|/)app/(.*/)?route\.(ts|js)$")
    pages = file.rlike(r"(^|/)pages/(.*/)?api/")

    def found(pattern: str, path: Column, router: str) -> Column:
        verb = lambda m: F.upper(m["g1"])
        said = lambda m: F.concat_ws(" ", verb(m), path)
        return _as_signals(matches(c, pattern), 0, "route", text=said, name=said, tags=("route", verb, lambda m: path, "nextjs", router), confidence=0.85, framework="nextjs", route=lambda m: (verb(m), path))

    a, p = found(rules.APP_ROUTE, E.app_path(E.dirname(file)), "app-router"), found(rules.PAGES_ROUTE, E.pages_path(file), "pages-router")
    return _spread(sources, [F.when(app, a).when(pages, p).otherwise(F.slice(a, 1, 0))], F.lit("typescript"), dedup=False)


def react_components(sources: DataFrame) -> DataFrame:
    c = F.col("content")
    some = sources.filter(F.col("file").rlike(r"\.(tsx|jsx|ts|js)$"))
    arrays = [
        _as_signals(matches(c, p), i, "component", text=_template("Component {0}"), name=lambda m: m["g1"], tags=("component", lambda m: m["g1"], "react"), confidence=0.85, framework="react", keep=lambda m: E.is_component(m["g1"]))
        for i, p in enumerate(rules.COMPONENTS)
    ]
    return _spread(some, arrays, F.lit("typescript"), dedup=False)


def _named(found: Column, rule: int, kind: str, name) -> Column:
    return F.transform(found, lambda m, n: F.struct(F.lit(rule).alias("rule"), n.alias("nth"), F.lit(kind).alias("kind"), name(m).alias("name")))


def fixture_signals(sources: DataFrame) -> DataFrame:
    """(file, kind, name, line, text, emit_pos) by rules for single lines; names with a leading underscore are left out."""
    lines = sources.select("file", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    arrays = []
    for i, (kind, pattern) in enumerate(rules.FIXTURE_RULES):
        groups = 2 if kind == "route" else 1
        found = matches(F.col("line"), pattern, groups)
        if kind == "function":
            found = F.filter(found, lambda m: ~m["g1"].startswith("_") & (m["g1"] != "constructor"))
        name = (lambda m: F.concat_ws(" ", F.upper(m["g1"]), m["g2"])) if kind == "route" else (lambda m: m["g1"])
        arrays.append(_named(found, i, kind, name))
    rows = lines.select("file", "at", "line", F.explode(F.concat(*arrays)).alias("s"))
    return rows.select("file", "s.kind", "s.name", (F.col("at") + 1).alias("line"), F.substring(E.trim_all(F.col("line")), 1, 100).alias("text"), F.struct("at", "s.rule", "s.nth").alias("emit_pos"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their 0-based place within each file."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy(*by)) - 1)
