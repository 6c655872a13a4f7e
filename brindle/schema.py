"""Schemas, vocabularies and settings of the signal store."""

from __future__ import annotations

from dataclasses import dataclass

SIGNAL = (
    "id string, evidence_id string, session_id string, kind string, language string, file string, name string, line_start int, line_end int, "
    "framework string, route struct<method:string,path:string,handler:string>, text string, tags array<string>, confidence double, created_at timestamp, updated_at timestamp"
)
EVIDENCE = "id string, source_type string, file string, content_hash string, raw_size bigint, created_at timestamp, metadata map<string,string>"
TOOL_OUTPUT = "id string, session_id string, tool string, input string, output string, created_at timestamp"
FILE_META = "path string, mtime timestamp, hash string, indexed_at timestamp"
INDEX_META = "last_indexed_at timestamp, total_files bigint, total_signals bigint, raw_source_chars bigint, signal_chars bigint, version string"
SEARCH_LOG = "query string, results_count int, ts timestamp"
JOURNAL = "ts timestamp, level string, mode string, action string, query string, tool string, chars bigint, results int, read_after boolean, duration_ms bigint, details map<string,string>"
FIXTURE_SIGNAL = "kind string, name string, file string, line int, text string"
GROUND_TRUTH = (
    "fixture string, version string, totalFiles int, totalSourceChars bigint, queries array<struct<id:string,query:string,category:string,"
    "expected:struct<kind:string,method:string,path:string,file:string,handler:string,lineRequired:boolean>,difficulty:string>>"
)

# The catalogue of kinds, in order.
KINDS = ("file", "import", "export", "function", "class", "interface", "type", "component", "route", "middleware", "symbol", "diagnostic")


@dataclass(frozen=True)
class ScanRules:
    """Which files a scan takes."""

    # Folders that scans leave out, and the extensions they take.
    ignored_folders: tuple[str, ...] = ("node_modules", ".git", "dist", "build", ".next", "out", "coverage", ".cache", "turbo", "vendor", ".svn", "__pycache__", "venv", ".venv", "env")
    extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java", ".rb", ".php", ".rs", ".swift", ".kt")
    max_bytes: int = 10 * 1024 * 1024


@dataclass(frozen=True)
class Scoring:
    """Weights of the structural score."""

    name: float = 4.0
    route_path: float = 4.0
    route_method: float = 4.0
    file: float = 2.0
    tags: float = 3.0
    text: float = 1.0
    min_score: float = 0.1


@dataclass(frozen=True)
class Bm25:
    """Weights and constants of the ranked index."""

    k: float = 1.2
    b: float = 0.7
    d: float = 0.5
    fuzzy: float = 0.15
    prefix_weight: float = 0.375
    fuzzy_weight: float = 0.45
    boosts: tuple[tuple[str, float], ...] = (("text", 1.0), ("file", 2.0), ("name", 4.0), ("kind", 2.0), ("language", 1.0), ("tags", 3.0))


@dataclass(frozen=True)
class Search:
    limit: int = 8
    bm25_weight: float = 0.7
    scoring_weight: float = 0.3
    min_score: float = 0.05
    candidate_factor: int = 3
