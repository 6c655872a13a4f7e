"""A quality classifier: naive Bayes support vectors.

A document's features are indicators of its hashed n-grams: words, pairs of words, pairs of word shapes
(letters, capitals, digits, each other sign), and a word said twice or three times running.  Each indicator is scaled by the log ratio of its smoothed shares
of the two classes' counts, and a linear model with hinge loss is fit to the scaled, length-normalised indicators
by dual coordinate descent.  The margin is turned into a score by a logistic curve fitted on rows that the
model has not seen.

The model is fit on at most `sample` labelled rows (those with the smallest hashes of their doc_id) with at most
`most_features` features in sum (of longer texts there are fewer rows then); scoring covers all rows.  Model and sample are bounded by parameters, so they may be collected and broadcast.

Null or empty text has no features and gets the score of the model's intercept.  Labels other than 0 and 1
and labels without a document are ignored; of several labels for one doc_id the smallest holds.  Without both
classes the score is the share of label 1 (0.5 without labels).  Rows are scored one by one: repeated rows get equal
scores, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed
from .textbytes import chunks, column_buffer, gram_hashes, mix64, word_hashes, word_spans

BITS = 18
#: The largest number of labelled rows the model is fit on.
SAMPLE = 6000
#: The largest number of features, over all rows it is fit on, of 4 bytes each.
SAMPLE_FEATURES = 1 << 25

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[0x80:] = 97


def _shape_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words' shapes: runs of the same kind of sign count once."""
    shape = _SHAPE[buf]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    place = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(new, out=place[1:])
    return word_hashes(shape[new], place[starts], place[ends])


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all rows, row by row, and where each row's begin."""
    starts, ends, first = word_spans(buf, offsets)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    words, shapes = word_hashes(buf, starts, ends), _shape_hashes(buf, starts, ends)
    inside = row[1:] == row[:-1]
    same = inside & (words[1:] == words[:-1])
    twice = np.flatnonzero(same)
    thrice = twice[1:][np.diff(twice) == 1]
    kinds = [(row[twice], np.full(len(twice), 0x2222 << 48, np.uint64)), (row[thrice], np.full(len(thrice), 0x3333 << 48, np.uint64))]
    kinds += [(row, words), (row[:-1][inside], gram_hashes(words, 2)[inside]), (row[:-1][inside], gram_hashes(shapes, 2)[inside] ^ np.uint64(0x5555)), (row, mix64(shapes + np.uint64(0x77)))]
    keys = np.concatenate([r.astype(np.uint64) << np.uint64(bits) | h >> np.uint64(64 - bits) for r, h in kinds])
    keys.sort()
    keep = np.ones(len(keys), bool)
    keep[1:] = keys[1:] != keys[:-1]
    keys = keys[keep].astype(np.int64)
    return keys & ((1 << bits) - 1), np.searchsorted(keys >> bits, np.arange(rows + 1))


@dataclass
class Model:
    """weights: of each feature (log-count ratio times the linear model's); the margin is their mean-free, normalised sum."""

    weights: np.ndarray
    scales: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margins(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids])])
        norm = np.concatenate([[0.0], np.cumsum(self.scales[ids] ** 2)])
        return (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(norm[at[1:]] - norm[at[:-1]], 1e-9)) + self.intercept

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ids, at) + self.offset, -35, 35)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([x for x, label in zip(rows, y, strict=True) if label == k] or [np.zeros(0, np.int64)]), minlength=size) + smooth for k in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and intercept of min |w|^2/2 + sum of hinge losses, by one dual variable at a time.

    The rarer class's losses cost as much in sum as the other's.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    share = np.array([max((y < 0).mean(), 1e-9), max((y > 0).mean(), 1e-9)])
    limit = cost * 0.5 / np.where(y > 0, share[1], share[0])
    squares = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(y)).tolist():
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            if (alpha[i] == 0 and gradient >= 0) or (alpha[i] == limit[i] and gradient <= 0):
                continue
            new = min(max(alpha[i] - gradient / squares[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[rows[i]] += step * values[i]
            bias += step
            largest = max(largest, abs(gradient))
        if largest < 0.01:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (positive) and offset of the curve that gives margins their chance of label 1, by Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, v = p - target, p * (1 - p) + 1e-6
        h = np.array([[v @ margins**2 + 1e-3, v @ margins], [v @ margins, v.sum() + 1e-3]])
        step = np.linalg.solve(h, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """rows: each document's distinct features."""
    size = 1 << bits
    if len(set(labels.tolist())) < 2:
        p = min(max(float(labels.mean()), 1e-6), 1 - 1e-6) if len(labels) else 0.5
        return Model(np.zeros(size), np.zeros(size), float(np.log(p / (1 - p))), 1.0, 0.0)

    def linear(which: np.ndarray) -> Model:
        some, y = [rows[i] for i in which], labels[which]
        ratio = log_count_ratio(some, y, size)
        values = [(ratio[x] / max(np.sqrt(ratio[x] @ ratio[x]), 3e-5)).astype(np.float32) for x in some]
        w, bias = dual_coordinate_descent(some, values, np.where(y == 1, 1.0, -1.0), size)
        return Model(ratio * w, ratio, bias, 1.0, 0.0)

    def margins(model: Model, which: np.ndarray) -> np.ndarray:
        return model.margins(np.concatenate([rows[i] for i in which] or [np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(rows[i]) for i in which])]).astype(np.int64))

    everything = np.arange(len(labels))
    unseen, seen = everything[::4], np.delete(everything, everything[::4])
    model = linear(everything)
    if len(set(labels[seen].tolist())) == 2 and len(set(labels[unseen].tolist())) == 2:
        model.slope, model.offset = logistic_curve(margins(linear(seen), unseen), labels[unseen])
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, bits: int = BITS, most_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most `sample` of the labelled rows whose crc32(key) mod 5 is not 0, and `most_features`: so bounded, they may be collected."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    marked = marked.groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = column_buffer(batch.column(2))
            for i, j in chunks(offsets):
                ids, at = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                blobs = [ids[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(blobs, pa.binary())], names=["_id", "_label", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    found = texts.select("_id", F.col("_label").cast("int"), "_text").mapInArrow(run, f"_id {kind}, _label int, ids binary")
    # One row for each doc_id, whatever rows repeat it: so the sample's bound holds.
    rows = checkpointed(found.groupBy("_id", "_label").agg(F.min("ids").alias("ids")))
    sizes = sorted(rows.select(F.xxhash64("_id"), "_id", F.length("ids")).collect())
    within = int(np.searchsorted(np.cumsum([n // 4 for *_, n in sizes]), most_features, "right"))
    if within < len(sizes):
        digest, first, _ = sizes[within]
        rows = rows.filter((F.xxhash64("_id") < digest) | (F.xxhash64("_id") == digest) & (F.col("_id") < first))
    rows = rows.toArrow().sort_by("_id")
    return fit([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("ids")], rows.column("_label").to_numpy().astype(np.int64), bits)


def score(docs: DataFrame, model: Model, carry: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """The carried columns of every row as struct `row`, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2**bits

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        model, out = shared.value, [np.zeros(0)]
        buf, offsets = column_buffer(texts)
        for i, j in chunks(offsets):
            out.append(model.scores(*features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)))
        return pa.array(np.concatenate(out))

    # Only the texts go to Python; the other columns stay where they are.
    return docs.select(F.struct(*(docs[c] for c in carry)).alias("row"), scored(docs[text]).alias("score"))


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0
