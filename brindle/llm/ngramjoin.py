"""N-gram Jaccard join: count-vector R-trees over the shingles that documents share.

A document is the set of its distinct n-word shingles, hashed to 64 bits.  Shingles that no other document holds can't be
part of any overlap, so they count for a document's size and for nothing else:

1. All shingles are dealt out by ranges of their hash, sorted, about 8 bytes each.  A shingle that several documents of a batch
   hold goes out once for the batch, so a hot one makes a row's part a batch, not a row a document.  Back comes which are
   held elsewhere too, and how many documents hold them, to the power of two.
2. A document of n shingles of which c are shared can be similar only where 100 c >= percent n; the others are done.  The
   same is said once more of those that are left, each set once: so only keys count that two of them hold.
3. Rarer shingles come first, those of one document before all.  Two sets with similarity s share one of the first
   n - ceil(s n) + 1 shingles of both, which leaves c - ceil(s n) + 1 shared ones to deal documents out by.
4. The shared shingles fall into GROUPS groups by their hash, and a document's point is its count in each group.  Two
   sets can't share more than the sum of their points' coordinate minima, and the maxima of an R-tree node's points bound
   all points below it the same way.  Every group of documents with a shingle in common is joined with itself: one of at
   most 48 pair by pair with the same bound and no tree, a larger one by an R-tree on (points, sizes), nodes against
   nodes; node pairs go whose bound is too low for their sizes, and node pairs that lie in one known component.
5. Surviving pairs are verified on the shared shingles of both, which hold their whole overlap, and on their whole sizes.
6. Rounds: the first deals out three shingles a document and tries few partners, which finds nearly all components.
   Before each following one, shingles count only that documents of two components hold, and documents go by the rule of
   step 2: so a group of near copies that nothing else contests is done.  A document tries its `tries` best-bounded
   partners a part, and while any had more than that, another round follows with 16 times as many.  So every link
   between two components is tested in the end, and groups of near copies don't become all their pairs.

A shingle that more than `hot` documents hold is dealt out in blocks: as pairs of blocks, or in the first round in two
blocks for each document; no task gets an unbounded group.  The texts are read once for all this, and once more for their length.

Exact copies (equal sets) are one node of the graph from the start.  Null or empty texts, and those without words, have empty
sets, link with nothing and are their own component.  A text with fewer words than n has its whole sequence as
the one shingle.  Rows that share a doc_id are rows of their own.  A null doc_id is never the smallest; a component
of nulls alone has none.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .shared import checkpointed, shuffle_partitions
from .textbytes import chunks, column_buffer, mix64, shingle_sets

GROUPS = 256
LEAF = 32
FAN = 32
#: Shingles that a task gathers before it deals them out, and documents (their places take two bytes).
BATCH_KEYS, BATCH_DOCS = 2_000_000, 60_000
#: Shingles that meet in one part.
PART_KEYS = 1_000_000
#: Bytes of the records that one task holds at a time.
PART_BYTES = 24 << 20


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def least_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that two sets with these sizes in sum need at least."""
    return -(-percent * sizes // (100 + percent))


def _texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of (…, text) batches with their rows' sets."""
    for batch in batches:
        buf, offsets = column_buffer(batch.column(batch.num_columns - 1))
        for i, j in chunks(offsets):
            yield batch.slice(i, j - i), shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)


def _set_hash(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of hashes that a key is in: keys in order have parts in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _pack(keys: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted keys and their places, compressed: the bytes of the keys' differences and of the places, the highest of all first."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0)).astype(">u8")
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(keys), -1).T).tobytes() for x in (steps, places.astype(">u2"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob) if blob else b"", np.uint8).reshape(10, -1)
    steps, places = (np.ascontiguousarray(planes[i:j].T).view(t).ravel() for i, j, t in ((0, 8, ">u8"), (8, 10, ">u2")))
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64), places.astype(np.int64)


_DEALT = "part int, batch bigint, keys binary, comps binary, many binary, first int, counts binary, low binary, high binary, home binary"


class _Gathered:
    """Documents of one batch: ids where there are any, nodes, components, sizes, and the keys of those that are dealt out."""

    def __init__(self):
        self.docs, self.valid, self.nodes, self.comps, self.sizes, self.deals, self.keys = [], [], [], [], [], [], []
        self.held = 0

    def add(self, doc: int | None, node: int, comp: int, size: int, keys: np.ndarray | None) -> None:
        self.docs.append(doc or 0)
        self.valid.append(doc is not None)
        self.nodes.append(node)
        self.comps.append(comp)
        self.sizes.append(size)
        if keys is not None and len(keys):
            self.deals.append(len(self.docs) - 1)
            self.keys.append(keys)
            self.held += len(keys)

    @property
    def full(self) -> bool:
        return self.held >= BATCH_KEYS or len(self.docs) >= BATCH_DOCS

    def dealt(self, batch: int, parts: int, contested: bool) -> Iterator[pa.RecordBatch]:
        """Rows of _DEALT: for each part the keys of one document with its place, and those of many; and what stays at home."""
        if not self.docs:
            return
        key = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        place = np.repeat(np.arange(len(self.keys), dtype=np.uint16), [len(k) for k in self.keys])
        order = np.argsort(key)
        key, place = key[order], place[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(key)))
        lone, many = starts[counts == 1], starts[counts > 1]
        several, counts = counts[counts > 1], None
        inside = np.repeat(many, several) + np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
        comps = np.array(self.comps, np.int64)
        ids = [np.array(x, t) for x, t in ((self.docs, np.int64), (self.valid, bool), (self.nodes, np.int64))]
        home = pickle.dumps((*ids, comps, np.array(self.sizes, np.int64), np.array(self.deals, np.int64), key[many], several, place[inside]))
        own = comps[self.deals] if len(self.deals) else comps[:0]
        many_keys, lone_keys, lone_places = key[many], key[lone], place[lone]
        runs = np.cumsum(several) - several
        low = np.minimum.reduceat(own[place[inside]], runs) if contested and len(many) else own[:0]
        high = np.maximum.reduceat(own[place[inside]], runs) if contested and len(many) else own[:0]
        bounds = np.arange(parts + 1)
        a, b = np.searchsorted(_part(lone_keys, parts), bounds), np.searchsorted(_part(many_keys, parts), bounds)
        out: list[list] = [[] for _ in range(10)]
        for p in np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])).tolist():
            i, j, k, m = int(a[p]), int(a[p + 1]), int(b[p]), int(b[p + 1])
            row = (p, batch, _pack(lone_keys[i:j], lone_places[i:j]), own[lone_places[i:j]].tobytes() if contested else b"", _pack(many_keys[k:m], np.zeros(m - k)), k, several[k:m].astype(np.uint32).tobytes(), low[k:m].tobytes(), high[k:m].tobytes(), None)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        for column, x in zip(out, (batch % parts, batch, b"", b"", b"", 0, b"", b"", b"", home), strict=True):
            column.append(x)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _DEALT.split(", ")])


def _from_texts(n: int, parts: int):
    """Documents with their whole sets.  A copy of one before it in the task isn't dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, some = TaskContext.get().partitionId() << 32, set(), _Gathered()
        for part, sets in _texts(batches, n):
            for doc, s in zip(part.column(0).to_pylist(), sets, strict=True):
                node = _set_hash(s) if len(s) else 0
                some.add(doc, node, node, len(s), None if node in seen else s)
                seen.add(node)
                if some.full:
                    yield from some.dealt(at, parts, False)
                    at, some = at + 1, _Gathered()
        yield from some.dealt(at, parts, False)

    return run


def _from_rows(parts: int, contested: bool):
    """Documents with the keys that counted so far: (node, comp, n_shingles, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, some = TaskContext.get().partitionId() << 32, _Gathered()
        for batch in batches:
            for node, comp, size, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some.add(None, node, comp, size, np.frombuffer(keys, np.uint64))
                if some.full:
                    yield from some.dealt(at, parts, contested)
                    at, some = at + 1, _Gathered()
        yield from some.dealt(at, parts, contested)

    return run


_NOT = 255
_FOUND = "batch bigint, keys binary, classes binary, first int, many binary, home binary"


def _find(contested: bool):
    """What is held elsewhere too of one part's keys: by another document, or by one of another component."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, homes = [], []
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(1, 10)), strict=True):
                if x[8] is not None:
                    homes.append((x[0], None, None, 0, None, x[8]))
                else:
                    rows.append(x)
        unpacked = [_unpack(x[1]) for x in rows]
        lone, places, many = [x for x, _ in unpacked], [x for _, x in unpacked], [_unpack(x[3])[0] for x in rows]
        keys = np.concatenate([np.zeros(0, np.uint64), *lone, *many])
        weight = np.concatenate([np.ones(sum(map(len, lone)), np.int64), *(np.frombuffer(x[5], np.uint32) for x in rows)]).astype(np.int64)
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        starts = np.flatnonzero(new)
        held = np.add.reduceat(weight[order], starts) if len(keys) else weight
        good = held > 1
        if contested and len(keys):
            low = np.concatenate([np.frombuffer(x[i], np.int64) for i in (2, 6) for x in rows])
            high = np.concatenate([np.frombuffer(x[i], np.int64) for i in (2, 7) for x in rows])
            good = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
        kind = np.where(good, np.floor(np.log2(np.maximum(held, 1))), _NOT).astype(np.uint8)
        classes = np.empty(len(keys), np.uint8)
        classes[order] = kind[np.cumsum(new) - 1]
        ends = np.cumsum([*map(len, lone), *map(len, many)])
        each = np.split(classes, ends[:-1]) if len(rows) else []
        out: list[list] = [list(c) for c in zip(*homes, strict=True)] or [[] for _ in range(6)]
        for i, x in enumerate(rows):
            some = each[i] != _NOT
            if not some.any() and not len(many[i]):
                continue
            row = (x[0], _pack(lone[i][some], places[i][some]), each[i][some].tobytes(), x[4], each[len(rows) + i].tobytes(), None)
            for column, v in zip(out, row, strict=True):
                column.append(v)
        kinds = [pa.int64(), *[pa.binary()] * 2, pa.int32(), *[pa.binary()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


_KEPT = "doc bigint, node bigint, comp bigint, n_shingles bigint, batch bigint, place int, keys binary, classes binary"


def _assemble(percent: int):
    """A batch's documents: the keys that count, rarest first, and their classes; null where they are too few for any link."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, home = [], None
        for batch in batches:
            for *x, own in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if own is not None:
                    home = pickle.loads(own)
                else:
                    found.append((*_unpack(x[0]), *x[1:]))
        docs, valid, nodes, comps, sizes, deals, many_keys, many_counts, many_places = home
        kinds = np.full(len(many_keys), _NOT, np.uint8)
        for x in found:
            kinds[x[3] : x[3] + len(x[4])] = np.frombuffer(x[4], np.uint8)
        some = kinds != _NOT
        flags = np.repeat(some, many_counts)
        place = np.concatenate([*(x[1] for x in found), many_places[flags]]).astype(np.int64)
        keys = np.concatenate([*(x[0] for x in found), np.repeat(many_keys[some], many_counts[some])])
        kind = np.concatenate([*(np.frombuffer(x[2], np.uint8) for x in found), np.repeat(kinds[some], many_counts[some])])
        held = np.bincount(place, minlength=len(deals))
        good = (held > 0) & (100 * held >= percent * sizes[deals])
        kept = good[place]
        place, keys, kind = place[kept], keys[kept], kind[kept]
        order = np.lexsort((keys, kind, place))
        place, keys, kind = place[order], keys[order], kind[order]
        own, of_kind = [None] * len(docs), [None] * len(docs)
        ends = np.searchsorted(place, np.flatnonzero(good), "right")
        start = 0
        for row, end in zip(deals[good].tolist(), ends.tolist(), strict=True):
            own[row], of_kind[row] = keys[start:end].tobytes(), kind[start:end].tobytes()
            start = end
        n = len(docs)
        columns = [pa.array(docs, mask=~valid), pa.array(nodes, mask=sizes == 0), pa.array(comps), pa.array(sizes), pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(own, pa.binary()), pa.array(of_kind, pa.binary())]
        names = [c.split()[0] for c in _KEPT.split(", ")]
        for i in range(0, n, 1000):
            yield pa.RecordBatch.from_arrays([c.slice(i, 1000) for c in columns], names=names)

    return run


def _counted(source: DataFrame, deal, contested: bool, percent: int) -> DataFrame:
    """Checkpointed rows of _KEPT."""
    found = source.mapInArrow(deal, _DEALT).groupBy("part").applyInArrow(_find(contested), _FOUND)
    return checkpointed(found.groupBy("batch").applyInArrow(_assemble(percent), _KEPT))


def _parts(spark: SparkSession, keys: int) -> int:
    return max(4 * shuffle_partitions(spark), -(-keys // PART_KEYS))


def _recounted(rows: DataFrame, contested: bool, percent: int) -> DataFrame:
    """(node, comp, n_shingles, keys, classes) with the keys only that two documents, or components, of these hold; others go."""
    held = rows.agg(F.sum(F.length("keys"))).first()[0] or 0
    deal = _from_rows(_parts(rows.sparkSession, held // 8), contested)
    return _counted(rows.select("node", "comp", "n_shingles", "keys"), deal, contested, percent).filter("keys is not null").select("node", "comp", "n_shingles", "keys", "classes")


_CLAIMED = [("key", "<u4"), ("doc", "<u4")]


def _document(width: int) -> list:
    return [("node", "<i8"), ("comp", "<i8"), ("n", "<u4"), ("points", f"<u{width}", GROUPS)]


def _spread(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part and 4 bytes of each key, and the order by part."""
    mixed = mix64(keys)
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    return part, mixed.astype(np.uint32), np.argsort(part, kind="stable")


def _in_blocks(key: np.ndarray, owner: np.ndarray, nodes: np.ndarray, blocks: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of hot shingles once for each pair of blocks that the document's is one of; or (not every) for two blocks."""
    large, rest = np.flatnonzero(blocks > 1), np.flatnonzero(blocks <= 1)
    if not len(large):
        return key, owner
    times = blocks[large]
    seed = nodes[owner[large]].view(np.uint64)
    if not every:
        first, second = (mix64(seed + np.uint64(s)) % times.astype(np.uint64) + np.uint64(s << 32) for s in (1, 2))
        hot = [mix64(key[large] + mix64(b)) for b in (first, second)]
        return np.concatenate([key[rest], *hot]), np.concatenate([owner[rest], owner[large], owner[large]])
    own = (mix64(seed) % times.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(large)), times)
    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    pair = np.minimum(own[at], other) * (1 << 20) + np.maximum(own[at], other)
    return np.concatenate([key[rest], mix64(key[large][at] + pair.astype(np.uint64) + np.uint64(1))]), np.concatenate([owner[rest], owner[large][at]])


def _deal(parts: int, percent: int, first: int | None, hot: int):
    """Rows (part, width, documents, claims): a part's documents once each, and its keys with places among them.

    The keys are those that links must share, or the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, comps, sizes = (batch.column(i).to_numpy() for i in range(3))
            keys, points, held = [], np.zeros((len(nodes), GROUPS), np.int64), []
            for i, (own, kind) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                own, kind = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(kind.as_buffer(), np.uint8)
                points[i] = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
                take = len(own) - -(-percent * int(sizes[i]) // 100) + 1
                take = take if first is None else min(take, first)
                keys.append(own[:take])
                held.append(kind[:take])
            owner = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
            blocks = -(-(2 << np.concatenate(held).astype(np.int64)) // hot)
            key, owner = _in_blocks(np.concatenate(keys), owner, nodes, blocks, first is None)
            width = 1 if points.max() < 256 else 2 if points.max() < 65536 else 4
            table = np.zeros(len(nodes), _document(width))
            table["node"], table["comp"], table["n"], table["points"] = nodes, comps, sizes, points
            part, short, order = _spread(key, parts)
            part, short, owner = part[order], short[order], owner[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            documents, claims = [], []
            for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
                own, place = np.unique(owner[i:j], return_inverse=True)
                claim = np.zeros(j - i, _CLAIMED)
                claim["key"], claim["doc"] = short[i:j], place
                documents.append(table[own].tobytes())
                claims.append(claim.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), width, np.int32)), pa.array(documents, pa.binary()), pa.array(claims, pa.binary())], names=["part", "width", "documents", "claims"])

    return run


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of places within runs."""
    total = int(sizes.sum())
    run = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = starts[run] + local
    more = sizes[run] - 1 - local
    left = np.repeat(place, more)
    step = np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more)
    return left, left + 1 + step


class RTree:
    """Points packed by size and then by their most varied coordinate; each level keeps maxima, sizes and components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * max(1, int(np.sqrt(len(order) / LEAF)))
        for a in range(0, len(order), slab):
            some = order[a : a + slab]
            side = int(np.argmax(points[some].var(0)))
            order[a : a + slab] = some[np.argsort(points[some, side], kind="stable")]
        self.order = order
        self.levels = []
        high, least, most, comp = points[order], sizes[order], sizes[order], comps[order].copy()
        mixed = np.zeros(len(order), bool)
        fan = LEAF
        while len(high) > 1:
            cuts = np.arange(0, len(high), fan)
            first = comp[cuts]
            differs = mixed | (comp != np.repeat(first, np.diff(np.append(cuts, len(comp)))))
            high, least, most = np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            comp, mixed = first, np.logical_or.reduceat(differs, cuts)
            self.levels.append((high, least, most, comp, mixed, fan))
            fan = FAN

    def candidate_blocks(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves whose bounds allow a link, a few thousand at a time."""
        top = len(self.levels) - 1
        todo = [(top, *np.triu_indices(len(self.levels[top][0])))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > 20_000:
                todo += [(level, i[a : a + 20_000], j[a : a + 20_000]) for a in range(0, len(i), 20_000)]
                continue
            high, least, most, comp, mixed, _ = self.levels[level]
            keep = (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i]) & (mixed[i] | mixed[j] | (comp[i] != comp[j]))
            i, j = i[keep], j[keep]
            keep = np.minimum(high[i], high[j]).sum(1) >= least_overlap(least[i].astype(np.int64) + least[j], percent)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if not level:
                for a in range(0, len(i), 1000):
                    yield i[a : a + 1000], j[a : a + 1000]
                continue
            below = len(self.levels[level - 1][0])
            c = np.arange(FAN)
            left = np.repeat(i[:, None, None] * FAN + c[None, :, None], FAN, 2).ravel()
            right = np.repeat(j[:, None, None] * FAN + c[None, None, :], FAN, 1).ravel()
            keep = (left < below) & (right < below) & (left <= right)
            todo.append((level - 1, left[keep], right[keep]))


class Tries:
    """The best-bounded `limit` partners of each document that tries, over all its shingles here; `cut`: some had more."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.rows, self.cut = limit, [], 0, False

    def add(self, who: np.ndarray, partner: np.ndarray, estimate: np.ndarray) -> None:
        self.parts.append((who, partner, estimate))
        self.rows += len(who)
        if self.rows > 1_000_000:
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        who, partner, estimate = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        _, once = np.unique(who << 32 | partner, return_index=True)
        who, partner, estimate = who[once], partner[once], estimate[once]
        order = np.lexsort((mix64((partner ^ who).view(np.uint64)), -estimate, who))
        who, partner, estimate = who[order], partner[order], estimate[order]
        start = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        keep = rank < self.limit
        self.cut |= not keep.all()
        self.parts, self.rows = [(who[keep], partner[keep], estimate[keep])], int(keep.sum())


def group_candidates(claims: np.ndarray, documents: np.ndarray, percent: int, limit: int, small: int = 48) -> tuple[np.ndarray, np.ndarray, bool]:
    """Node pairs to verify among documents dealt out by shingle, and whether some had more partners than the limit.

    claims: (key, place among documents); documents: (node, comp, n, points), some of them there twice.
    """
    names, first, which_node = np.unique(documents["node"], return_index=True, return_inverse=True)
    documents = documents[first]
    pairs = np.unique(claims["key"].astype(np.uint64) << np.uint64(32) | which_node.ravel()[claims["doc"]].astype(np.uint64))
    key, doc = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same_next = np.zeros(len(key), bool)
    same_next[:-1] = key[1:] == key[:-1]
    shared = same_next.copy()
    shared[1:] |= same_next[:-1]
    key, doc = key[shared], doc[shared]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    comp, size, points = documents["comp"][doc], documents["n"][doc].astype(np.int64), documents["points"]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(starts, len(key)))
    run = np.repeat(np.arange(len(starts)), counts)
    # How many members of a run are of the same component: the smaller side tries.
    by = np.lexsort((comp, run))
    new = np.ones(len(by), bool)
    new[1:] = (run[by][1:] != run[by][:-1]) | (comp[by][1:] != comp[by][:-1])
    which = np.cumsum(new) - 1
    crowd = np.empty(len(by), np.int64)
    crowd[by] = np.bincount(which)[which]

    def offer(i: np.ndarray, j: np.ndarray, store: Tries, bound: np.ndarray) -> None:
        turn = (crowd[i] > crowd[j]) | (crowd[i] == crowd[j]) & (comp[i] > comp[j])
        store.add(doc[np.where(turn, j, i)], doc[np.where(turn, i, j)], bound / (size[i] + size[j] - bound))

    def test(i: np.ndarray, j: np.ndarray, store: Tries) -> None:
        keep = (comp[i] != comp[j]) & (100 * size[i] >= percent * size[j]) & (100 * size[j] >= percent * size[i])
        left, right = i[keep], j[keep]
        for a in range(0, len(left), 50_000):
            i, j = left[a : a + 50_000], right[a : a + 50_000]
            bound = np.minimum(points[doc[i]], points[doc[j]]).sum(1, dtype=np.int64)
            keep = bound >= least_overlap(size[i] + size[j], percent)
            if keep.any():
                offer(i[keep], j[keep], store, bound[keep])

    store = Tries(limit)
    little = np.flatnonzero(counts <= small)
    a = 0
    while a < len(little):
        pairs = np.cumsum(counts[little[a : a + 50_000]] * (counts[little[a : a + 50_000]] - 1) // 2)
        b = a + max(1, int(np.searchsorted(pairs, 1_000_000)))
        test(*_pairs_within(counts[little[a:b]], starts[little[a:b]]), store)
        a = b
    for r in np.flatnonzero(counts > small).tolist():
        begin, m = int(starts[r]), int(counts[r])
        own = slice(begin, begin + m)
        if (comp[own] == comp[begin]).all():
            continue
        tree = RTree(points[doc[own]], size[own], comp[own])
        c = np.arange(LEAF)
        for i, j in tree.candidate_blocks(percent):
            left = np.repeat(i[:, None, None] * LEAF + c[None, :, None], LEAF, 2).ravel()
            right = np.repeat(j[:, None, None] * LEAF + c[None, None, :], LEAF, 1).ravel()
            ok = (left < m) & (right < m) & (left < right)
            test(begin + tree.order[left[ok]], begin + tree.order[right[ok]], store)
    store.shrink()
    if not store.parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    who, partner, _ = store.parts[0]
    a, b = np.minimum(names[who], names[partner]), np.maximum(names[who], names[partner])
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    return pairs[:, 0], pairs[:, 1], store.cut


def _candidates(rows: DataFrame, percent: int, limit: int, first: int | None, hot: int) -> DataFrame:
    """(a, b, cut): distinct pairs of nodes to verify."""
    # Each shingle's record is a document with its points at most: as many parts as memory asks for.
    wanted = F.length("keys") / 8 - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1
    claims = rows.agg(F.sum(wanted if first is None else F.least(wanted, F.lit(first)))).first()[0] or 0
    partitions = shuffle_partitions(rows.sparkSession)
    parts = max(partitions, int(claims) * (GROUPS + 24) // PART_BYTES)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        current = None

        def flush():
            full = _document(max(w for w, _, _ in held))
            tables = [np.frombuffer(d, _document(w)) for w, d, _ in held]
            starts = np.cumsum([0, *map(len, tables)])
            claims = [np.frombuffer(c, _CLAIMED).copy() for _, _, c in held]
            for claim, start in zip(claims, starts, strict=False):
                claim["doc"] += np.uint32(start)
            documents = np.concatenate([t.astype(full) for t in tables])
            held.clear()
            a, b, cut = group_candidates(np.concatenate(claims), documents, percent, limit)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), cut))], names=["a", "b", "cut"])

        for batch in batches:
            for part, *blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current and held:
                    yield flush()
                current = part
                held.append(tuple(blob))
        if held:
            yield flush()

    dealt = rows.select("node", "comp", "n_shingles", "keys", "classes").mapInArrow(_deal(parts, percent, first, hot), "part int, width int, documents binary, claims binary")
    found = dealt.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(group, "a bigint, b bigint, cut boolean")
    return found.groupBy("a", "b").agg(F.max("cut").alias("cut"))


def _verified(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: their keys hold all that both share."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            for n, x, y in zip(total.tolist(), batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (n - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    x, y = (rows.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "keys_a", "keys_b")
    return checkpointed(both.mapInArrow(verify, "a bigint, b bigint"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, tries: int = 16, hot: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Checkpointed documents (doc, node, n_shingles) and links (a, b) between nodes.

    A node is a set; the links connect all sets that a path of similar pairs connects.
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(docs[key].cast("bigint").alias("doc"), docs[text].alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = _counted(source, _from_texts(n, _parts(spark, size // 6)), False, percent)
    members = counted.select("doc", "node", "n_shingles")
    some = counted.filter("keys is not null")
    # Copies in other tasks: one of each set goes on.  Chosen by small rows, so that a hot set is no heap of large ones.
    one = some.groupBy("node").agg(F.min(F.struct("batch", "place")).alias("one")).select("node", "one.*")
    rows = _recounted(some.join(one, ["node", "batch", "place"], "left_semi"), False, percent)
    edges = _verified(rows, checkpointed(_candidates(rows, percent, 2, 3, hot)), percent)
    while True:
        known = components(edges).select("node", F.col("component").alias("label"))
        labelled = rows.join(known, "node", "left").withColumn("comp", F.coalesce("label", "node"))
        rows = _recounted(labelled, True, percent)
        pairs = checkpointed(_candidates(rows, percent, tries, None, hot))
        n_pairs, cut = pairs.agg(F.count("*"), F.max("cut")).first()
        if n_pairs:
            edges = checkpointed(edges.union(_verified(rows, pairs, percent)))
        if not cut:
            return members, edges
        tries *= 16


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, **settings) -> DataFrame:
    """(key, n_shingles, component_id, node, component) of every row: component_id is the smallest key that links reach.

    node is the set, component what links connect: two components can have one component_id where keys repeat.  Both
    are null for empty sets.
    """
    table, edges = links(docs, key, text, n, percent, **settings)
    # Both small sides are written first: so the joins' large sides are dealt out by themselves, and hot labels and sets split.
    found = checkpointed(components(edges).select("node", F.col("component").alias("label")))
    rows = table.filter("node is not null").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = checkpointed(rows.groupBy("label").agg(F.min("doc").alias("component_id")))
    out = rows.join(smallest, "label").select(F.col("doc").alias(key), "n_shingles", "component_id", "node", F.col("label").alias("component"))
    none = F.lit(None).cast("bigint")
    return out.unionByName(table.filter("node is null").select(F.col("doc").alias(key), "n_shingles", F.col("doc").alias("component_id"), none.alias("node"), none.alias("component")))


def with_nodes(docs: DataFrame, text: str = "text", n: int = 5) -> DataFrame:
    """The rows with their set (node, as similar_groups names it) as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, some in _texts(iter([batch.select([text])]), n) for s in some]
            node = pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], names=[*batch.schema.names, "node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("node", LongType())]))
