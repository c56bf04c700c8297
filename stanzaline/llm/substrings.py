"""Substring dedup with difference-cover anchors.

A word is removed when a window of ``WINDOW`` words that covers it also starts in a document with a
smaller doc_id. Three steps find exactly those windows without hashing all of them together:

1. Anchors. Short windows are hashed at the positions whose remainder modulo ``PERIOD`` is in a
   difference cover. Two equal windows of WINDOW words, wherever they start, hold an equal anchor at
   the same distance from their starts.
2. Extension. Around anchors that another document has too, windows of WINDOW words are hashed, in
   96 bits; such a window is removed if a smaller doc_id has it.
3. The removed windows go back to their documents.

Hashes travel as packed chunks, one row for each bucket and batch; documents are dealt once by a hash
of the row and meet the results of steps 1 and 2 in the same partitions. A hash that many documents of
one chunk have is answered within the chunk as far as it can be, and only its least and greatest
document ask the others, so a passage that a third of all documents share sends a few rows per chunk.

Defined cases: a null text has no words; repeated rows and rows with the same doc_id do not remove
each other; a null doc_id is larger than all others; texts below WINDOW words stay whole; an empty
table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PERIOD = 50, 31
#: A perfect difference cover modulo 31: every remainder is a difference of two of these.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
_rng = np.random.default_rng(50_031)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = (np.uint64(int(x) * 8 + 5) for x in _rng.integers(1 << 57, 1 << 60, 2))
_POWERS: dict[int, np.ndarray] = {}
LARGEST = np.int64((1 << 63) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 12) * 2, base, np.uint64))])
        _POWERS[int(base)] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_INVERSES = {int(b): pow(int(b), -1, 1 << 64) for b in (_P, _Q)}


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[start:end] for many spans, free of where the span lies."""
    n = len(values)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(base, n))])
    shift = _powers(np.uint64(_INVERSES[int(base)]), n + 1)
    return _mix((total[ends] - total[starts]) * shift[starts])


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a UTF-8 text, in bytes."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return _spans(_BYTES[np.frombuffer(data, np.uint8)], starts, ends, _P)


def windows(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``size`` words from each start."""
    return _spans(words, starts, starts + size, _P), _spans(words ^ _BYTES[7], starts, starts + size, _Q)


def anchor_positions(n: int) -> np.ndarray:
    if n < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    return at[np.isin(at % PERIOD, COVER)]


def near_windows(n: int, shared: np.ndarray) -> np.ndarray:
    """Starts of windows that hold one of the shared anchors at a distance below PERIOD."""
    hit = np.zeros(n + 2, np.int32)
    np.add.at(hit, np.maximum(shared - PERIOD + 1, 0), 1)
    np.add.at(hit, shared + 1, -1)
    return np.flatnonzero(np.cumsum(hit)[: n - WINDOW + 1] > 0)


#: Occurrences of a hash in one chunk from which on the chunk answers for itself.
OFTEN = 8


class Chunks:
    """Packs (hash, check, row, doc_id, position) by hash bucket.

    Rows of ``flush`` are questions (home -1) or answers, which pass through any bucket to their home.
    """

    def __init__(self, count: int, home: int, smaller: bool):
        self.count, self.home, self.smaller = count, home, smaller
        self.parts, self.rows, self.docs, self.held = [], [], [], 0

    def add(self, row: int, doc_id: int, hashes: np.ndarray, checks: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            self.parts.append((hashes, checks.astype(np.uint32), at.astype(np.uint32)))
            self.rows.append(row)
            self.docs.append(doc_id)
            self.held += len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            hashes, checks, at = (np.concatenate(x) for x in zip(*self.parts))
            own = np.repeat(np.arange(len(self.parts), dtype=np.uint32), [len(p[0]) for p in self.parts])
            rows, docs = np.array(self.rows, np.int64), np.array(self.docs, np.int64)
            order = np.argsort(hashes, kind="stable")
            hashes, checks, at, own = hashes[order], checks[order], at[order], own[order]
            asks, known = self._settle(hashes, checks, docs[own])
            if known is not None:
                homes, data = _answer_rows(rows[own[known]], at[known], self.home)
                yield _chunk_batch([h % self.count for h in homes], homes, data)
                hashes, checks, at, own = hashes[asks], checks[asks], at[asks], own[asks]
            # buckets are ranges of hashes, so these are in their order already
            bucket = ((hashes >> np.uint64(32)) * np.uint64(self.count) >> np.uint64(32)).astype(np.int32)
            names, data = [], []
            for part in np.split(np.arange(len(hashes)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(part):
                    used, local = np.unique(own[part], return_inverse=True)
                    names.append(int(bucket[part[0]]))
                    data.append(_pack(rows[used], docs[used], hashes[part], checks[part], local.astype(np.uint32), at[part]))
            yield _chunk_batch(names, [-1] * len(names), data)
        self.__init__(self.count, self.home, self.smaller)

    def _settle(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Occurrences that ask the others, and those whose answer this chunk knows (None: it knows none)."""
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sizes = np.diff(np.r_[first, len(hashes)])
        if not (often := sizes >= OFTEN).any():
            return np.arange(len(hashes)), None
        rank = np.repeat(first, sizes)
        same = checks == checks[rank]  # an equal hash of other words asks for itself
        least, most = (np.repeat(f.reduceat(np.where(same, ids, v), first), sizes) for f, v in ((np.minimum, np.int64(LARGEST)), (np.maximum, np.int64(-LARGEST))))
        several = np.repeat(often, sizes) & same & (least != most)
        if self.smaller:
            # the least document asks whether there is a smaller one; all others have one here
            known = several & (ids > least)
            return np.flatnonzero(~known), np.flatnonzero(known) if known.any() else None
        # one occurrence each of the least and the greatest document stands for all
        asks = ~several
        for end in (least, most):
            hit = np.flatnonzero(several & (ids == end))
            asks[hit[np.unique(rank[hit], return_index=True)[1]]] = True
        return np.flatnonzero(asks), np.flatnonzero(several) if several.any() else None


def _chunk_batch(buckets: list[int], homes: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(homes, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "home", "data"])


def _answer_rows(rows: np.ndarray, at: np.ndarray, home: int) -> tuple[list[int], list[bytes]]:
    """Positions of rows, packed by their home bucket."""
    homes = np.mod(rows, home)
    order = np.lexsort((at, rows, homes))
    rows, at, homes = rows[order], at[order], homes[order]
    names, data = [], []
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(homes)) + 1):
        used, local = np.unique(rows[part], return_inverse=True)
        names.append(int(homes[part[0]]))
        data.append(np.array([len(used), len(part)], np.int64).tobytes() + used.tobytes() + local.astype(np.uint32).tobytes() + at[part].astype(np.uint32).tobytes())
    return names, data


_KINDS = (np.int64, np.int64, np.uint64, np.uint32, np.uint32, np.uint32)


def _pack(rows, docs, hashes, checks, local, at) -> bytes:
    return np.array([len(rows), len(hashes)], np.int64).tobytes() + b"".join(x.astype(k).tobytes() for x, k in zip((rows, docs, hashes, checks, local, at), _KINDS))


def _unpack(data: bytes) -> list[np.ndarray]:
    few, many = (int(x) for x in np.frombuffer(data, np.int64, 2))
    found, at = [], 16
    for kind, n in zip(_KINDS, (few, few, many, many, many, many)):
        found.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return found


_CHUNK, _ANSWER = "bucket int, home int, data binary", "bucket int, data binary"
#: Hashes that a mapper holds before it sends them on.
_HELD = 1_500_000


def _answers(smaller: bool, home: int):
    """Positions whose hash another document has too (``smaller``: one with a smaller doc_id), packed by home bucket of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for known, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if known < 0:
                    parts.append(_unpack(data))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([known], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])
        if not parts:
            return
        base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        rows, docs, hashes, checks = (np.concatenate([p[i] for p in parts]) for i in range(4))
        own = np.concatenate([p[4].astype(np.int64) + b for p, b in zip(parts, base)])
        at = np.concatenate([p[5] for p in parts])
        del parts
        order = np.lexsort((checks, hashes))
        hashes, checks, own, at = hashes[order], checks[order], own[order], at[order]
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
        ids = docs[own]
        least, sizes = np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(ids)])
        if smaller:
            hit = ids > np.repeat(least, sizes)
        else:
            hit = np.repeat(least != np.maximum.reduceat(ids, first), sizes)
        own, at = own[hit], at[hit]
        if not len(own):
            return
        names, data = _answer_rows(rows[own], at, home)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _by_row(table: pa.Table) -> dict[int, np.ndarray]:
    """Positions by row out of one home bucket's answers."""
    rows, at = [], []
    for data in table.column("data").to_pylist():
        few, many = (int(x) for x in np.frombuffer(data, np.int64, 2))
        own = np.frombuffer(data, np.int64, few, 16)
        rows.append(own[np.frombuffer(data, np.uint32, many, 16 + 8 * few)])
        at.append(np.frombuffer(data, np.uint32, many, 16 + 8 * few + 4 * many).astype(np.int64))
    if not rows:
        return {}
    rows, at = np.concatenate(rows), np.concatenate(at)
    order = np.argsort(rows, kind="stable")
    rows, at = rows[order], at[order]
    cuts = np.flatnonzero(np.diff(rows)) + 1
    return {int(r[0]): a for r, a in zip(np.split(rows, cuts), np.split(at, cuts))}


def _texts(table: pa.Table) -> Iterator[tuple[int, int, int | None, bytes]]:
    for batch in table.to_batches(max_chunksize=500):
        for row, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text"))):
            yield row, LARGEST if doc_id is None else doc_id, doc_id, text or b""


def _ranges(at: np.ndarray, n: int) -> list[dict]:
    """Word ranges that windows at these starts cover, merged."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    inside = np.r_[False, np.cumsum(edge)[:n] > 0, False]
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return [{"start": int(a), "end": int(b)} for a, b in zip(turn[0::2], turn[1::2])]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word ranges) and kept_text of every row."""
    buckets = common.buckets(docs)
    # several home buckets for each partition, so that the chance of the hash evens out
    home = 8 * buckets
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = rows.select(F.pmod("row", F.lit(home)).cast("int").alias("bucket"), "row", "doc_id", "text").repartition(buckets, "bucket")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Chunks(buckets, home, smaller=False)
        for batch in batches:
            for row, order, _, text in _texts(pa.Table.from_batches([batch])):
                words = word_hashes(text)
                at = anchor_positions(len(words))
                if len(at):
                    found.add(row, order, *windows(words, at, ANCHOR), at)
                if found.held > _HELD:
                    yield from found.flush()
        yield from found.flush()

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, found, out = _by_row(right), Chunks(buckets, home, smaller=True), []
        if shared:
            for row, order, _, text in _texts(left):
                if (hits := shared.get(row)) is not None:
                    words = word_hashes(text)
                    at = near_windows(len(words), np.unique(hits))
                    if len(at):
                        found.add(row, order, *windows(words, at, WINDOW), at)
                    if found.held > _HELD:
                        out += found.flush()
            out += found.flush()
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("data", pa.binary())]))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        gone, out = _by_row(right), []
        for row, _, doc_id, text in _texts(left):
            words = text.split()
            ranges = _ranges(np.unique(gone[row]), len(words)) if row in gone else []
            kept, at = [], 0
            for r in ranges:
                kept += words[at : r["start"]]
                at = r["end"]
            out.append((doc_id, len(words), sum(r["end"] - r["start"] for r in ranges), ranges, b" ".join(kept + words[at:]).decode()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT) if out else _RESULT.empty_table()

    def answered(chunks: DataFrame, smaller: bool) -> DataFrame:
        return chunks.repartitionById(buckets, "bucket").mapInArrow(_answers(smaller, home), _ANSWER).repartition(buckets, "bucket")

    def met(answers: DataFrame):
        return texts.groupBy("bucket").cogroup(answers.groupBy("bucket"))

    shared = answered(rows.mapInArrow(anchors, _CHUNK), smaller=False)
    removed = answered(met(shared).applyInArrow(extend, _CHUNK), smaller=True)
    return met(removed).applyInArrow(remove, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
