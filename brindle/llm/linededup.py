"""Line deduplication that returns keep bitmaps.

Lines become (hash, document, position) rows that are range-partitioned by hash and document and sorted by
hash, document (largest first) and position.  One pass streams each partition's runs of a hash: the first
document of a run is the one that keeps its lines.  Since the document is part of the range, a line that a third
of all documents hold is spread over many tasks; a run that touches an end of its partition may go on in the
next, so such runs (two for each partition at most) are summed up and joined back by their hash.  Of a run that began here
no more than its first `min_docs` documents are held or summed: the keeper is among them, and they are enough to count.

A line's key is the line stripped of x20 and x09-x0D at both ends with A-Z lower-cased.  Keys of at least
`min_chars` code points found in at least `min_docs` documents lose all their lines but those in the largest
doc_id holding it.  Null or empty text is one empty line.  Rows without doc_id are kept whole and not counted.
Rows that share a doc_id are one document when documents are counted.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_partitions
from .textbytes import LOWER, SPACE, chunks, column_buffer, word_hashes

_LINES = "h1 bigint, h2 bigint, doc bigint, tag bigint, n_lines int, pos int"
_NEWLINE = 10


def _line_table(buf: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Row, position and both hashes of each line whose key is long enough, and every row's number of lines."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(buf == _NEWLINE)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    n_lines = np.bincount(row_of_break, minlength=rows) + 1
    row = np.repeat(np.arange(rows), n_lines)
    first = np.cumsum(n_lines) - n_lines
    pos = np.arange(len(row)) - first[row]
    start, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    start[first] = offsets[:-1]
    end[first + n_lines - 1] = offsets[1:]
    inner = np.ones(len(row), bool)
    inner[first] = False
    start[inner] = breaks + 1
    inner[:] = True
    inner[first + n_lines - 1] = False
    end[inner] = breaks
    solid = np.flatnonzero(~SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    some = np.flatnonzero(b > a)
    start, end = solid[a[some]], solid[b[some] - 1] + 1
    long = points[end] - points[start] >= min_chars
    some, start, end = some[long], start[long], end[long]
    low = LOWER[buf]
    return row[some], pos[some], word_hashes(low, start, end), word_hashes(low, start, end, 1), n_lines


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, offsets = column_buffer(batch.column(2))
            for i, j in chunks(offsets):
                row, pos, h1, h2, n = _line_table(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h1.view(np.int64), h2.view(np.int64), doc[i + row], tag[i + row], n[row].astype(np.int32), pos.astype(np.int32))],
                    names=["h1", "h2", "doc", "tag", "n_lines", "pos"],
                )

    return run


def _stream_runs(min_docs: int):
    """Of the sorted rows: those to drop, and (edge) all of the first and the last run, which go on elsewhere perhaps."""

    def decide(rows: dict[str, np.ndarray], first_is_edge: bool, last_is_edge: bool) -> pa.RecordBatch | None:
        h1, h2, doc = rows["h1"], rows["h2"], rows["doc"]
        if not len(h1):
            return None
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        docs = np.add.reduceat(other, at)
        edge = (run == 0) & first_is_edge | (run == len(at) - 1) & last_is_edge
        out = edge | (docs[run] >= min_docs) & (doc != doc[at][run])
        return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (*rows.values(), edge)], names=[*rows, "edge"])

    def some(rows: dict[str, np.ndarray], out: np.ndarray, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (*rows.values(), np.full(len(rows["h1"]), edge))], names=[*rows, "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "tag", "n_lines", "pos"]
        # left: rows of the last run that wait; going: its hashes once later rows needn't wait; first: it is the partition's first.
        left, going, first = None, None, True
        for batch in batches:
            rows = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            if going is not None:
                same = (rows["h1"] == going[0]) & (rows["h2"] == going[1])
                n = len(same) if same.all() else int(np.argmin(same))
                keeper = None if first else left["doc"][0]
                out = np.arange(n) if first else np.flatnonzero(rows["doc"][:n] != keeper)
                if len(out):
                    yield some(rows, out, first)
                rows = {k: v[n:] for k, v in rows.items()}
                if not len(rows["h1"]):
                    continue
                if not first:
                    yield some(left, np.flatnonzero(left["doc"] != keeper), False)
                left, going, first = None, None, False
            if left is not None:
                rows = {k: np.concatenate([left[k], rows[k]]) for k in names}
            if not len(rows["h1"]):
                continue
            same = (rows["h1"] == rows["h1"][-1]) & (rows["h2"] == rows["h2"][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            left = {k: v[cut:] for k, v in rows.items()}
            if cut and (out := decide({k: v[:cut] for k, v in rows.items()}, first, False)):
                yield out
                first = False
            last = left["h1"][0], left["h2"][0]
            if first:
                # It may have begun in the partition before: all of it is summed elsewhere.
                yield some(left, np.arange(len(left["h1"])), True)
                left, going = None, last
            elif (docs := np.cumsum(left["doc"] != np.concatenate([left["doc"][:1] - 1, left["doc"][:-1]])))[-1] > min_docs:
                # Its first min_docs documents wait, since it may go on in the next partition; the others' lines go in any case.
                head = int(np.searchsorted(docs, min_docs, "right"))
                yield some(left, np.arange(head, len(docs)), False)
                left, going = {k: v[:head].copy() for k, v in left.items()}, last
        if left is not None:
            yield some(left, np.arange(len(left["h1"])), True)

    return run


def drops(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, tag, n_lines, pos) of every line to drop; tag tells apart different texts under one doc_id."""
    n = shuffle_partitions(docs.sparkSession)
    source = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    # Written first: cutting ranges takes a sample, which else hashes all lines a second time.
    lines = checkpointed(source.mapInArrow(_hash_lines(min_chars), _LINES))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tag"), F.col("pos")]
    ordered = checkpointed(lines.repartitionByRange(n, *order[:3]).sortWithinPartitions(*order))
    runs = ordered.mapInArrow(_stream_runs(min_docs), _LINES + ", edge boolean")
    edges = runs.filter("edge")
    # At most two keys for each partition, whatever the input: small enough to send to every task.
    totals = edges.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("docs"), F.max("doc").alias("keeper")).filter(F.col("docs") >= min_docs)
    across = edges.join(F.broadcast(totals), ["h1", "h2"]).filter("doc <> keeper")
    return runs.filter("not edge").select("doc", "tag", "n_lines", "pos").unionByName(across.select("doc", "tag", "n_lines", "pos"))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(key, tag, n_lines, n_dropped, keep) of every document that loses lines.

    keep: zlib-compressed bits, one for each line, the first line's the highest of the first byte; 1 stays.
    tag: xxhash64 of the text.  Documents that aren't there keep all lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_dropped, keep = [], []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[gone] = 0
                n_dropped.append(n - int(bits.sum()))
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())], names=[key, "tag", "n_lines", "n_dropped", "keep"])

    by_doc = drops(docs, key, text, min_chars, min_docs).groupBy("doc", "tag").agg(F.first("n_lines").alias("n_lines"), F.collect_list("pos").alias("gone"))
    return by_doc.mapInArrow(run, f"`{key}` bigint, tag bigint, n_lines int, n_dropped bigint, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> str:
    if not text or keep is None:
        return text or ""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([x for x, bit in zip(lines, bits.tolist(), strict=True) if bit])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as a struct `row`, with n_lines, n_dropped and the `kept` text.

    The join deals the texts out by document; no document's rows grow with the corpus, so no key is hot.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[key].cast("bigint").alias("_doc"), F.xxhash64(docs[text]).alias("_tag"), docs[text].alias("_text"))
    marks = bitmaps.select(F.col(key).alias("_d"), F.col("tag").alias("_t"), F.col("n_dropped").alias("_n"), F.col("keep").alias("_keep"))
    joined = rows.join(marks, (F.col("_doc") == F.col("_d")) & (F.col("_tag") == F.col("_t")), "left")

    @F.arrow_udf("string")
    def kept(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        return pa.array([kept_lines(t.as_py(), k.as_py()) for t, k in zip(texts, keeps, strict=True)], pa.string())

    lines = F.coalesce(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    return joined.select(
        "row",
        lines.cast("bigint").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).alias("n_dropped"),
        F.when(F.col("_keep").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept("_text", "_keep")).alias("kept"),
    )
