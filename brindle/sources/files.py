"""Sources and sinks: source trees, JSON and Parquet relations, versioned stores, corpus sizes, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..schema import ScanRules


def supported(path, rules: ScanRules = ScanRules()):
    """Whether a scan takes the path: no folder left out, an extension taken."""
    return ~E.ignored_folder(path, rules.ignored_folders) & E.extension(path).isin(*rules.extensions)


def _base(spark: SparkSession, root: str) -> str:
    """The root as the file source names it in front of its files' paths: absolute, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"


def scan_tree(spark: SparkSession, root: str, rules: ScanRules = ScanRules(), content: bool = True, oversize: bool = False) -> DataFrame:
    """(path, mtime, size[, content, hash]) of the files below root that the rules take; path is relative to root.

    Without content only the listing is read: the file source prunes the column.  The rules' filters on
    path and length run before content is decoded.  oversize: those instead that are too large to be taken.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root.rstrip("/"))
    # Paths differ from the root's form in the slashes after the scheme at most, so both are cut there.
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    base = "/" + _base(spark, root).split(":", 1)[-1].lstrip("/")
    fits = F.col("length") > rules.max_bytes if oversize else F.col("length") <= rules.max_bytes
    files = files.filter(fits).withColumn("relative", F.substring(bare("path"), F.lit(len(base) + 1), F.length("path"))).filter(supported("relative", rules))
    columns = [F.col("relative").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    if content:
        columns += [F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash")]
    return files.select(*columns)


def content_evidence(files: DataFrame, now) -> DataFrame:
    """Evidence rows of scanned files; ids follow from path and content, so reruns agree."""
    return files.select(
        F.sha2(F.concat_ws("|", "path", "hash"), 256).alias("id"),
        F.lit("file").alias("source_type"),
        F.col("path").alias("file"),
        F.col("hash").alias("content_hash"),
        F.length("content").cast("bigint").alias("raw_size"),
        now.alias("created_at"),
        F.create_map(F.lit("language"), E.language(F.col("path"))).alias("metadata"),
    )


def tool_outputs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(id, session_id, tool, input, output, created_at) rows as evidence of tools."""
    from ..schema import TOOL_OUTPUT

    return spark.createDataFrame(rows, TOOL_OUTPUT)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON relation; a missing file gives no rows, malformed fields give nulls."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


class Store:
    """A relation in Parquet folders that are named by manifests: writers never overwrite what readers read.

    A commit writes a folder and then the next manifest, which must not be there yet: of two writers one fails.  append adds
    a folder to those of the manifest before, write begins anew; after COMPACT folders an append rewrites them as one.  Readers take the last
    manifest.  vacuum removes all but the last `keep` manifests and the folders that none of these name; write and
    append call it, so a frame that was read before the last `keep` commits can't be evaluated any more.
    """

    COMPACT = 32

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 4):
        self.spark, self.root, self.schema, self.keep = spark, root.rstrip("/"), schema, keep

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs, root = self._fs(), self._path()
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names() if n[:1] == "m" and n[-5:] == ".json" and n[1:-5].isdigit())

    def _folders(self, version: int) -> list[str]:
        stream = self._fs().open(self._path(f"m{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        """The current version; -1 without any."""
        return max(self._versions(), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        folders = self._folders(v) if v >= 0 else []
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def _commit(self, frame: DataFrame, before: list[str], version: int) -> int:
        folder = f"d{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.root}/{folder}")
        out = self._fs().create(self._path(f"m{version}.json"), False)
        out.write(bytearray(json.dumps([*before, folder]).encode()))
        out.close()
        self.vacuum()
        return version

    def write(self, frame: DataFrame) -> int:
        return self._commit(frame, [], self.version() + 1)

    def append(self, frame: DataFrame) -> int:
        v = self.version()
        before = self._folders(v) if v >= 0 else []
        if len(before) >= self.COMPACT:
            columns = self.read().columns
            return self._commit(self.read().unionByName(frame.select(*columns)).coalesce(max(1, self.bytes() >> 27)), [], v + 1)
        return self._commit(frame, before, v + 1)

    def vacuum(self) -> None:
        versions = self._versions()
        old, fs = versions[: -self.keep], self._fs()
        if not old:
            return
        used = {x for v in versions[-self.keep :] for x in self._folders(v)}
        gone = {x for v in old for x in self._folders(v)} - used
        for v in old:
            fs.delete(self._path(f"m{v}.json"), False)
        for x in gone:
            fs.delete(self._path(x), True)

    def clear(self) -> int:
        """Rows gone; the store stays as an empty version."""
        gone = self.read().count()
        self.write(self.spark.createDataFrame([], self.schema))
        return gone

    def bytes(self) -> int:
        v = self.version()
        return sum(self._fs().getContentSummary(self._path(x)).getLength() for x in self._folders(v)) if v >= 0 else 0


def corpus_size(files: DataFrame, content: str = "content", extensions: tuple[str, ...] | None = None, path: str = "path") -> DataFrame:
    """(total_chars, total_files) of a table of texts."""
    some = files if extensions is None else files.filter(E.extension(path).isin(*extensions))
    return some.agg(F.coalesce(F.sum(F.length(content)), F.lit(0)).cast("bigint").alias("total_chars"), F.count("*").alias("total_files"))


def head_chars(content, lines: int):
    """Characters of a text's first lines."""
    return F.length(F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n")).cast("bigint")


def fixtures(spark: SparkSession, folder: str) -> list[str]:
    """Names of the JSON files in a folder, without their suffix."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(n[:-5] for n in names if n.endswith(".json"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row for each query of a ground-truth file: (fixture, qpos, id, query, category, difficulty, expected)."""
    from ..schema import GROUND_TRUTH

    return read_json(spark, path, GROUND_TRUTH).select("fixture", F.posexplode("queries").alias("qpos", "q")).select("fixture", "qpos", "q.id", "q.query", "q.category", "q.difficulty", "q.expected")


def save_report(spark: SparkSession, path: str, report: dict | str) -> None:
    """A small report as one text file: Markdown as it is, else JSON."""
    text = report if isinstance(report, str) else json.dumps(report, indent=2, default=str)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
