"""Column builders: rounding, paths, languages, names, keys, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column) -> Column:
    """Integer nearest to x, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def decimals(x: Column, places: int = 2) -> Column:
    """x rounded to some decimal places, halves up, as a double."""
    return F.floor(x * F.lit(10.0**places) + F.lit(0.5)) / F.lit(10.0**places)


def reduction(before: Column, after: Column) -> Column:
    """Per cent saved; 0 without anything before."""
    return F.when(F.coalesce(before, F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(half_up((before - after) / before * 100))


def break_even(cost: Column, savings: Column, never: int = 999) -> Column:
    return F.when(savings > 0, F.ceil(cost / savings).cast("bigint")).otherwise(F.lit(never).cast("bigint"))


def trim_all(c: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(c, r"^[\s\x0B\u00A0\u2028\u2029\uFEFF]+|[\s\x0B\u00A0\u2028\u2029\uFEFF]+$", "")


def slashes(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(slashes(c), "/"), -1)


def dirname(c: Column | str) -> Column:
    return F.regexp_extract(slashes(c), r"^(.*)/[^/]*$", 1)


def extension(c: Column | str) -> Column:
    """The last dot and what follows, or nothing."""
    return F.regexp_extract(basename(c), r"(\.[^.]+)$", 1)


def path_extension(c: Column | str) -> Column:
    """As extension(), but a leading dot begins no extension and a last dot is one."""
    return F.regexp_extract(basename(c), r"[^.](?:.*[^.])?\.*?(\.[^.]*)$", 1)


def file_tags(file: Column) -> Column:
    """Base name, and extension without its dot."""
    return F.when(F.coalesce(file, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(basename(file), F.substring(path_extension(file), 2, 1000)))


def tag_set(*parts: Column) -> Column:
    """Distinct non-empty tags in order; parts are strings or arrays of strings."""
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")))


def strings(*values: Column | str) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values))


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(default))


def language(file: Column | str) -> Column:
    """By 16 extensions, else unknown."""
    return F.when(F.coalesce(col(file), F.lit("")) == "", "unknown").otherwise(_lookup(rules.LANGUAGE_BY_EXTENSION, F.lower(path_extension(file)), "unknown"))


def source_language(file: Column | str) -> Column:
    """For syntax extraction: the JavaScript extensions, else typescript."""
    return F.when(F.lower(extension(file)).isin(".js", ".jsx", ".mjs", ".cjs"), "javascript").otherwise("typescript")


def fallback_language(file: Column | str) -> Column:
    """For regex extraction: the TypeScript extensions, else javascript."""
    return F.when(F.lower(extension(file)).isin(".ts", ".tsx"), "typescript").otherwise("javascript")


def ignored_folder(path: Column | str, folders: tuple[str, ...]) -> Column:
    """Whether any folder of the path is left out: listed, or with a leading dot."""
    parts = F.split(slashes(path), "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(inner, lambda x: x.isin(*folders) | x.startswith("."))


def is_component(name: Column | str, excluded: tuple[str, ...] = rules.NOT_COMPONENTS) -> Column:
    c = col(name)
    first = F.substring(c, 1, 1)
    return (F.length(c) > 0) & (first == F.upper(first)) & ~c.rlike(r"^(_|use|set)") & ~c.isin(*excluded)


def is_http_method(name: Column | str, also: tuple[str, ...] = ()) -> Column:
    return F.lower(col(name)).isin(*rules.HTTP_METHODS, *also)


def signal_key(kind="kind", file="file", name="name", line="line_start", route="route") -> Column:
    """Identity of a signal: routes by method and path, others by name and line."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    method, path = col(route)["method"], col(route)["path"]
    is_route = (col(kind) == "route") & (none(method) != "") & (none(path) != "")
    return F.when(is_route, F.concat_ws("|", none(col(kind)), none(col(file)), method, path)).otherwise(F.concat_ws("|", *(none(col(c)) for c in (kind, file, name, line))))


def line_key(kind="kind", file="file", name="name", line="line_start", text="text") -> Column:
    """Identity by five parts."""
    return F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in (kind, file, name, line, text)))


def search_terms(query: Column | str, stop: tuple[str, ...] = rules.STOP_WORDS, most: int = 5) -> Column:
    words = F.split(F.lower(col(query)), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)), 1, most)


def tokens(c: Column | str) -> Column:
    """Lower-cased terms between white space and punctuation."""
    return F.filter(F.split(F.lower(col(c)), r"[\n\r\p{Z}\p{P}]+"), lambda t: t != "")


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(content, F.lit(1), offset.cast("int")), "\n"))


def token_estimate(chars: Column) -> Column:
    return half_up(chars / 4)


def frameworks(content: Column, file: Column, strict: bool = True) -> Column:
    """Detected frameworks in order.  strict: Express needs its own app or a call on app or router."""
    calls = content.rlike(rules.EXPRESS_CALLS) & (content.rlike(r"\b(app|router)\.(get|post|put|patch|delete|options|head)\s*\(") if strict else F.lit(True))
    script = file.rlike(r"\.(tsx|jsx|ts|js)$")
    return F.array_compact(
        F.array(
            F.when(content.rlike(rules.EXPRESS_APP) | calls, "express"),
            F.when(content.rlike(rules.FASTIFY_APP) | content.rlike(rules.FASTIFY_CALLS), "fastify"),
            F.when(content.rlike(rules.NEXT_PROJECT) | file.contains("next.config") | file.rlike(r"(^|/)app/(.*/)?route\.(ts|js)$") | file.rlike(r"(^|/)pages/(.*/)?api/"), "nextjs"),
            F.when((content.rlike(rules.REACT_PROJECT) | content.rlike(rules.REACT_COMPONENTS)) & script, "react"),
        )
    )


def app_path(directory: Column | str) -> Column:
    """The API path of an app-router folder: the parts after the segment `app`."""
    parts = F.split(slashes(directory), "/")
    after = F.slice(parts, F.array_position(parts, F.lit("app")).cast("int") + 1, F.size(parts))
    kept = F.filter(after, lambda p: (p != "") & ~p.isin("api", "route", "page"))
    catch = F.array_position(F.transform(kept, lambda p: p.rlike(r"^\[\.\.\.")), F.lit(True)).cast("int")
    named = F.transform(kept, lambda p: F.when(p.rlike(r"^\[\.\.\."), F.lit("*")).otherwise(F.regexp_replace(p, r"^\[(.*)\]$", "$1")))
    cut = F.when(catch > 0, F.slice(named, F.lit(1), catch)).otherwise(named)
    return F.when(F.array_position(parts, F.lit("app")) == 0, "/api").otherwise(F.concat(F.lit("/api"), F.array_join(F.transform(cut, lambda p: F.concat(F.lit("/"), p)), "")))


def pages_path(file: Column | str) -> Column:
    """The API path of a pages-router file: what follows the segment `pages`, index left out."""
    inside = F.regexp_extract(slashes(file), r"(?:^|/)pages(/.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(inside, r"\.[^./]+$", ""), r"/index$", "")
    named = F.regexp_replace(bare, r"\[([^\]]+)\]", ":$1")
    return F.when(named == "", "/api").otherwise(named)


def ago(moment: Column, now: Column) -> Column:
    """How long ago, in words."""
    seconds = F.unix_micros(now.cast("timestamp")) / 1_000_000 - F.unix_micros(moment.cast("timestamp")) / 1_000_000
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(seconds / n).cast("bigint") for n in (60, 3600, 86400))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "minute")).when(hours < 24, said(hours, "hour")).otherwise(said(days, "day"))


def bucket(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first step that value reaches, from above."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(value >= least, name)
    return out.otherwise(last)


def storage_status(percent: Column) -> Column:
    return bucket(percent, [(90, "Exceptional"), (70, "Strong"), (50, "Moderate"), (10, "Minimal")], "Below Threshold")


def retrieval_status(rate: Column) -> Column:
    return bucket(rate, [(80, "Excellent"), (60, "Good"), (40, "Moderate"), (20, "Poor")], "Below Threshold")


def break_even_status(queries: Column) -> Column:
    return bucket(queries, [(1000, "At Risk"), (500, "Extended"), (100, "Moderate")], "On Track")
