"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks that cover the whole document; each
chunk is max-pooled, chunks are combined by their mean and their maximum into one probability. Nothing
but the pooled filters goes into it.

Defined cases: a null or empty text is a document of padding bytes and has a score like any other;
unlabelled and conflicting labels are left out of training (a doc_id with both labels is conflicting);
of several texts of one labelled doc_id the least is learned from; repeated rows score alike; a null
doc_id has no label; very long texts are scored and learned from in slices; without labels of both
classes every score is 0.5; labels, lang, source and doc_id are never inputs; an empty table gives no
rows; the score's name gets underscores in front where a column has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

EMBED, WIDTH, STRIDE, FILTERS = 6, 16, 4, 32
#: Bytes of a chunk; neighbouring chunks share OVERLAP bytes, so no window falls between two.
CHUNK, OVERLAP = 1024, WIDTH - STRIDE
#: Labelled documents that a fit takes at most of class 0 and of class 1, by hash of doc_id.
MAX_PER_CLASS = (1200, 2400)
#: Bytes of text that a fit takes at most, in the same order; documents that do not fit any more are passed over.
MAX_BYTES = 64 << 20
STEPS, BATCH, RATE, SEED = 1300, 16, 0.004, 7
THRESHOLD = 0.7
_STEP = CHUNK - OVERLAP
#: Chunks scored at once, so that memory does not follow the length of a text.
_AT_ONCE = 256


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # 2 * FILTERS: of the mean, of the maximum
    offset: float
    constant: float | None = None


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that overlap and cover the whole text; the last row is padded with zero bytes."""
    count = max(1, -(-(len(data) - OVERLAP) // _STEP))
    padded = np.zeros((count - 1) * _STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (count, CHUNK), (_STEP, 1))


def _windows(model: Model, rows: np.ndarray) -> np.ndarray:
    """Embedded windows: chunk x place x WIDTH * EMBED."""
    x = model.embed[rows]
    n, size = x.shape[0], x.itemsize
    places = (CHUNK - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(x, (n, places, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * size, size))


def _responses(model: Model, rows: np.ndarray) -> np.ndarray:
    windows = _windows(model, rows)
    n, places, width = windows.shape
    return (np.ascontiguousarray(windows).reshape(n * places, width) @ model.filters).reshape(n, places, -1)


def _pooled(model: Model, rows: np.ndarray) -> np.ndarray:
    return np.maximum(_responses(model, rows).max(1) + model.bias, 0)


def _argmax(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled filters of every chunk, and the places that they come from."""
    out = _responses(model, rows)
    where = out.argmax(1)
    return np.maximum(np.take_along_axis(out, where[:, None], 1)[:, 0] + model.bias, 0), where


def score(model: Model, data: bytes) -> float:
    if model.constant is not None:
        return model.constant
    rows = chunks(data)
    total, top = np.zeros(FILTERS), np.zeros(FILTERS)
    for at in range(0, len(rows), _AT_ONCE):
        pooled = _pooled(model, rows[at : at + _AT_ONCE])
        total += pooled.sum(0, dtype=np.float64)
        top = np.maximum(top, pooled.max(0))
    z = float(np.concatenate([total / len(rows), top]) @ model.dense + model.offset)
    return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def _gradients(model: Model, data: bytes, label: int, into: dict[str, np.ndarray]) -> float:
    """Adds one document's gradients; forth and back over slices of its chunks."""
    rows = chunks(data)
    n = len(rows)
    pooled, where = (np.zeros((n, FILTERS), t) for t in (model.filters.dtype, np.int64))
    for at in range(0, n, _AT_ONCE):
        pooled[at : at + _AT_ONCE], where[at : at + _AT_ONCE] = _argmax(model, rows[at : at + _AT_ONCE])
    best = pooled.argmax(0)
    features = np.concatenate([pooled.mean(0), pooled.max(0)])
    p = 1 / (1 + np.exp(-np.clip(features @ model.dense + model.offset, -30, 30)))
    err = np.float32(p - label)
    into["dense"] += err * features
    into["offset"] += err
    back = np.repeat((err * model.dense[:FILTERS] / n)[None], n, 0)
    back[best, np.arange(FILTERS)] += err * model.dense[FILTERS:]
    back *= pooled > 0
    into["bias"] += back.sum(0)
    for at in range(0, n, _AT_ONCE):
        part, slope = rows[at : at + _AT_ONCE], back[at : at + _AT_ONCE]
        c, f = np.nonzero(slope)
        seen = part[c[:, None], where[at + c, f][:, None] * STRIDE + np.arange(WIDTH)]
        hit = model.embed[seen].reshape(len(c), WIDTH * EMBED)  # a slice may have none
        into["filters"] += _add(f, hit * slope[c, f][:, None], FILTERS).T
        into["embed"] += _add(seen.ravel(), (model.filters.T[f] * slope[c, f][:, None]).reshape(-1, EMBED), 256)
    return float(-np.log(max(1e-9, p if label else 1 - p)))


def _add(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, values.shape[1]), np.float32)
    np.add.at(out, index, values)
    return out


def fit(texts: list[bytes], labels: list[int], steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> Model:
    """Adam on the cross entropy, in a fixed number of steps."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    model = Model(normal(256, EMBED, by=0.5), normal(WIDTH * EMBED, FILTERS, by=0.15), np.zeros(FILTERS, np.float32), normal(2 * FILTERS, by=0.1), 0.0)
    by_class = [[i for i, y in enumerate(labels) if y == k] for k in (0, 1)]
    if not all(by_class):
        model.constant = 0.5
        return model
    names = ("embed", "filters", "bias", "dense", "offset")
    first, second = ({n: np.zeros_like(np.asarray(getattr(model, n), np.float32)) for n in names} for _ in range(2))
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(-(-steps * BATCH // len(texts)))])
    for step in range(1, steps + 1):
        part = order[(step - 1) * BATCH : step * BATCH]
        grads = {n: np.zeros_like(first[n]) for n in names}
        for i in part:
            _gradients(model, texts[i], labels[i], grads)
        pace = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for n in names:
            g = grads[n] / len(part) + 1e-4 * np.asarray(getattr(model, n), np.float32)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            change = pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
            setattr(model, n, (getattr(model, n) - change).astype(np.float32) if n != "offset" else float(model.offset - change))
    return model


def held_out(doc_id) -> bool:
    """Rows that no fit may learn from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def is_held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_per_class: tuple[int, int] = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of a bounded, hash-ordered sample of the labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~is_held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("y"), F.max(column).alias("most")).where("y = most")
    ranked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class[y]) for y in (0, 1)]
    sample = {r["doc_id"]: int(r["y"]) for part in ranked for r in part.select("doc_id", "y").collect()}
    if not sample:
        return fit([], [])
    # at most sum(max_per_class) ids, so the filter reaches the scan
    rows = docs.where(F.col("doc_id").isin(list(sample))).select("doc_id", F.col("text").cast("binary").alias("text"))
    sizes = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()}
    left, taken = max_bytes, []
    for i in sample:
        if sizes.get(i, max_bytes + 1) <= left:
            left -= sizes[i]
            taken.append(i)
    rows = rows.where(F.col("doc_id").isin(taken)).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text")).collect()
    rows = sorted((r["doc_id"], bytes(r["text"])) for r in rows)
    return fit([t for _, t in rows], [sample[i] for i, _ in rows])


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text; one pass, no shuffle."""
    at, fields, (name,) = docs.columns.index("text"), docs.schema, common.fresh(docs.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            scores = [score(model, t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*fields.fields, StructField(name, DoubleType())]))
