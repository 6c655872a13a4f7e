"""Signals from the output of tools: read, grep, glob, bash and language server, as column expressions.

Input: evidence rows (id, session_id, tool, output, created_at).  Output: signals with emit_pos, the order in
which an evidence's signals come.  Rules are tried as alternatives of one expression; nothing leaves the JVM
but trees of language-server symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import rules
from .merge import first_wins

_COLUMNS = ["evidence_id", "session_id", "kind", "language", "file", "name", "text", "line_start", "line_end", "tags", "confidence", "created_at", "emit_pos"]


def _signal(frame: DataFrame, kind, text, tags, confidence, pos, language=None, file=None, name=None, line=None, line_end=None) -> DataFrame:
    """One signal for each row of (id, session_id, created_at, ...)."""
    as_column = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return frame.select(
        F.col("id").alias("evidence_id"),
        "session_id",
        as_column(kind, "string").alias("kind"),
        as_column(language, "string").alias("language"),
        as_column(file, "string").alias("file"),
        as_column(name, "string").alias("name"),
        as_column(text, "string").alias("text"),
        as_column(line, "int").alias("line_start"),
        as_column(line if line_end is None else line_end, "int").alias("line_end"),
        tags.alias("tags"),
        as_column(confidence, "double").alias("confidence"),
        "created_at",
        as_column(pos, "bigint").alias("emit_pos"),
    )


def read_lines(evidence: DataFrame) -> DataFrame:
    """(evidence columns, file, line_no, text) of read output: kept lines are numbered before those are dropped that cleaning empties."""
    lines = evidence.filter("tool = 'read'").select("id", "session_id", "created_at", "output")
    lines = lines.withColumn("file", F.when(F.col("output").contains("<path>"), F.try_element_at(F.filter(F.transform(F.split("output", "\n"), E.trim_all), lambda t: t.startswith("<path>") & t.endswith("</path>")), F.lit(-1))))
    lines = lines.withColumn("file", F.expr("substring(file, 7, greatest(length(file) - 13, 0))"))
    each = lines.select("id", "session_id", "created_at", "file", F.posexplode(F.split("output", "\n")).alias("pos", "line")).withColumn("t", E.trim_all(F.col("line")))
    kept = each.filter((F.col("t") != "") & ~(F.col("t").startswith("<path>") & F.col("t").endswith("</path>")) & ~F.col("t").isin("<content>", "</content>"))
    kept = kept.withColumn("line_no", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    return kept.withColumn("text", E.trim_all(F.regexp_replace("line", r"^\d+:\s*", ""))).filter("text <> ''").select("id", "session_id", "created_at", "file", "line_no", "text")


def _first_match(c: Column, patterns) -> Column:
    """The first pattern's group that isn't empty."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, g), F.lit("")) for p, g in patterns))


def is_import(c: Column) -> Column:
    return _any(c, rules.IMPORT_LINES)


def _any(c: Column, patterns) -> Column:
    out = c.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | c.rlike(p)
    return out


def function_name(c: Column) -> Column:
    return _first_match(c, rules.FUNCTION_LINES)


def class_name(c: Column) -> Column:
    return _first_match(c, [(p, 1) for p in rules.CLASS_LINES])


def route(c: Column) -> Column:
    """Method and path of a route line, or null; a path may be empty."""
    out = None
    for p, method, path in rules.ROUTE_LINES:
        found = F.struct(F.upper(F.regexp_extract(c, p, method)).alias("method"), F.regexp_extract(c, p, path).alias("path"))
        out = F.when(c.rlike(p), found) if out is None else out.when(c.rlike(p), found)
    return out


def read_signals(evidence: DataFrame) -> DataFrame:
    """file_read, import, function, class and route signals of read output, first of equals."""
    lines = read_lines(evidence)
    lines = lines.withColumn("language", E.language("file")).withColumn("about", E.file_tags(F.col("file")))
    text, file = F.col("text"), F.coalesce("file", F.lit("unknown file"))
    lang, about, no = F.col("language"), F.col("about"), F.col("line_no")
    where = F.concat(F.lit(" in "), file, F.lit(" at line "), no.cast("string"))
    marked = F.struct(is_import(text).alias("is_import"), function_name(text).alias("fn"), class_name(text).alias("cls"), route(text).alias("rt"))
    found = lines.withColumn("m", marked).withColumn("file_named", F.col("file") != "")
    m, pos = found["m"], no.cast("bigint") * 4
    rt = F.concat_ws(" ", m["rt"]["method"], m["rt"]["path"])
    line = lambda kind, said, tags, sure, place, name: _entry(kind, said, E.tag_set(tags, about), sure, place, name, no)
    code = ~m["is_import"]
    entries = F.array_compact(
        F.array(
            F.when(m["is_import"], line("import", text, E.strings("import", lang), 0.85, pos, None)),
            F.when(code & m["fn"].isNotNull(), line("function", F.concat(F.lit("Function "), m["fn"], F.lit(" defined"), where), E.strings("function", m["fn"], lang), 0.9, pos + 1, m["fn"])),
            F.when(code & m["cls"].isNotNull(), line("class", F.concat(F.lit("Class/type "), m["cls"], F.lit(" defined"), where), E.strings("class", m["cls"], lang), 0.9, pos + 2, m["cls"])),
            F.when(code & m["rt"].isNotNull(), line("route", F.concat(F.lit("Route "), rt, where), E.strings("route", m["rt"]["method"], m["rt"]["path"], lang), 0.95, pos + 3, rt)),
            # Every line says that its file was read; of these the first stays.
            F.when(F.col("file_named"), _entry("file_read", F.concat(F.lit("Read file "), F.col("file")), E.tag_set(E.strings("file", "read", lang), about), 1.0, F.lit(0).cast("bigint"), None, None)),
        )
    )
    rows = found.select("id", "session_id", "created_at", "file", "language", F.explode(entries).alias("s")).select("id", "session_id", "created_at", "file", "language", "s.*")
    out = _signal(rows, F.col("kind"), F.col("text"), F.col("tags"), F.col("confidence"), F.col("emit_pos"), F.col("language"), F.col("file"), F.col("name"), F.col("line_start"))
    return first_wins(out, ["evidence_id", E.line_key().alias("k")], ["emit_pos"])


def _entry(kind: str, text: Column, tags: Column, confidence: float, pos: Column, name: Column | None, line: Column | None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), tags.alias("tags"), F.lit(confidence).alias("confidence"), pos.alias("emit_pos"),
        (none if name is None else name).cast("string").alias("name"), (none if line is None else line).cast("int").alias("line_start"),
    )


def grep_signals(evidence: DataFrame) -> DataFrame:
    """search_match signals: a header line sets the file for the `Line n:` lines after it."""
    each = evidence.filter("tool = 'grep'").select("id", "session_id", "created_at", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    header = F.nullif(F.regexp_extract("line", r"^([A-Za-z]:\\.*|/.*):$", 1), F.lit(""))
    each = each.withColumn("header", header).withColumn("file", F.last("header", ignorenulls=True).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    hits = each.filter(F.col("header").isNull() & F.col("file").isNotNull() & F.col("line").rlike(r"^\s*Line\s+(\d+):\s*(.*)$"))
    hits = hits.withColumn("no", F.regexp_extract("line", r"^\s*Line\s+(\d+):", 1).cast("int")).withColumn("said", F.regexp_extract("line", r"^\s*Line\s+\d+:\s*(.*)$", 1)).withColumn("language", E.language("file"))
    text = F.concat(F.lit("Search match in "), "file", F.lit(" at line "), F.col("no").cast("string"), F.lit(": "), "said")
    return _signal(hits, "search_match", text, E.tag_set(E.strings("search", "grep", F.col("language")), E.file_tags(F.col("file"))), 0.8, F.col("pos"), F.col("language"), F.col("file"), None, F.col("no"))


def glob_signals(evidence: DataFrame) -> DataFrame:
    """file_path signals: lines that hold a separator; equal ones stay."""
    each = evidence.filter("tool = 'glob'").select("id", "session_id", "created_at", F.posexplode(F.split("output", "\n")).alias("pos", "line")).withColumn("file", E.trim_all(F.col("line")))
    paths = each.filter((F.col("file") != "") & ~F.col("file").startswith("Found ") & F.col("file").rlike(r"[/\\]")).withColumn("language", E.language("file"))
    return _signal(paths, "file_path", F.concat(F.lit("Discovered file "), "file"), E.tag_set(E.strings("file", "path", F.col("language")), E.file_tags(F.col("file"))), 0.7, F.col("pos"), F.col("language"), F.col("file"))


def bash_kind(output: Column) -> Column:
    return F.when(F.substring(output, 1, 4000).rlike(rules.ERROR_OUTPUT), "error").otherwise("command_output")


def bash_signals(evidence: DataFrame) -> DataFrame:
    rows = evidence.filter("tool = 'bash'").withColumn("k", bash_kind(F.col("output")))
    bad = F.col("k") == "error"
    return _signal(rows, F.col("k"), F.substring("output", 1, 4000), E.tag_set(E.strings("bash", "command", F.when(bad, "error").otherwise("output"))), F.when(bad, 0.9).otherwise(0.65), 0)


def symbol(code: Column, part: int, default: str) -> Column:
    """Kind (0) or name (1) of a language-server symbol code."""
    table = F.create_map(*(F.lit(x) for c, pair in rules.SYMBOLS.items() for x in (c, pair[part])))
    return F.coalesce(F.element_at(table, code.cast("int")), F.lit(default))


_FLAT = "array<struct<name:string,kind:int,location:struct<uri:string,range:struct<start:struct<line:int>,end:struct<line:int>>>>>"


def lsp_signals(evidence: DataFrame) -> DataFrame:
    """Errors; flat symbol lists; symbol trees, walked depth first; else the raw output."""
    rows = evidence.filter("tool = 'lsp'").withColumn("bad", F.col("output").rlike(rules.LSP_ERROR))
    errors = _signal(rows.filter("bad"), "error", F.substring("output", 1, 2000), E.tag_set(E.strings("lsp", "error")), 0.9, 0)
    good = rows.filter("not bad").withColumn("json", F.try_parse_json("output")).withColumn("flat", F.from_json("output", _FLAT))
    first = F.expr("try_variant_get(json, '$[0].location', 'variant')")
    good = good.withColumn("is_flat", F.col("json").isNotNull() & first.isNotNull())
    flat = good.filter("is_flat").select("id", "session_id", "created_at", F.posexplode("flat").alias("pos", "s"))
    uri = F.regexp_replace("s.location.uri", r"^file://", "")
    file = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    kind = symbol(F.col("s.kind"), 0, "function")
    line = F.col("s.location.range.start.line")
    listed = _signal(flat, kind, F.concat_ws(" ", symbol(F.col("s.kind"), 1, "Symbol"), "s.name"), E.tag_set(E.strings(kind, F.col("s.name"))), 0.95, F.col("pos"), None, file, F.col("s.name"), line, F.lit(None))
    tree = good.filter("not is_flat").select("id", "session_id", "created_at", "output").mapInArrow(_walk_symbols, "id string, session_id string, created_at timestamp, pos int, name string, code int, detail string, first int, last int, output string")
    nodes = tree.filter("name is not null")
    kind = symbol(F.col("code"), 0, "function")
    said = F.when(F.coalesce("detail", F.lit("")) != "", F.concat_ws(": ", "name", "detail")).otherwise(F.concat_ws(" ", symbol(F.col("code"), 1, "Symbol"), "name"))
    walked = _signal(nodes, kind, said, E.tag_set(E.strings(kind, F.col("name"))), 0.95, F.col("pos"), None, None, F.col("name"), F.col("first"), F.col("last"))
    raw = _signal(tree.filter("name is null"), "lsp_result", F.substring("output", 1, 2000), E.tag_set(E.strings("lsp", "raw")), 0.7, 0)
    return errors.unionByName(listed).unionByName(walked).unionByName(raw)


def _walk_symbols(batches):
    """Document symbols in depth-first order; one row without a name where there are none."""
    import json

    import pyarrow as pa

    def line(x, *keys):
        for k in keys:
            x = x.get(k) if isinstance(x, dict) else None
        return x if isinstance(x, int) else None

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            try:
                top = json.loads(row["output"])
            except ValueError:
                top = None
            top = top.get("result") if isinstance(top, dict) else top
            stack, found = list(reversed(top)) if isinstance(top, list) else [], 0
            while stack:
                s = stack.pop()
                if not isinstance(s, dict) or not s.get("name"):
                    continue
                first = line(s, "selectionRange", "start", "line")
                first = line(s, "range", "start", "line") if first is None else first
                out.append([row["id"], row["session_id"], row["created_at"], found, str(s["name"]), s.get("kind"), s.get("detail"), first, line(s, "range", "end", "line"), None])
                found += 1
                if isinstance(s.get("children"), list):
                    stack += reversed(s["children"])
            if not found:
                out.append([row["id"], row["session_id"], row["created_at"], 0, None, None, None, None, None, row["output"]])
        names = ["id", "session_id", "created_at", "pos", "name", "code", "detail", "first", "last", "output"]
        kinds = [pa.string(), pa.string(), batch.schema.field("created_at").type, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def signals(evidence: DataFrame) -> DataFrame:
    """All tools' signals; other tools have none."""
    out = read_signals(evidence)
    for f in (grep_signals, glob_signals, bash_signals, lsp_signals):
        out = out.unionByName(f(evidence))
    return out.select(*_COLUMNS)
