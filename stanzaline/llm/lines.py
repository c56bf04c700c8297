"""Line dedup by pairwise alignment.

Documents overlap where they share a window: a shortest run of lines with MIN_BLOCK characters, be it one line
or many short ones. Of the many carriers of a window the earliest alone is a partner, so a document meets no more
others than it has windows, however many carry them. A later document and its partner are aligned line by line by
patience diff, over the stretch of each that reaches from the first to the last window for which they are
partners: lines that stand once in both are matched along their longest common order, then what lies between
two of them likewise; where no line stands once, the first occurrences of a line are matched, then the second ones.
Aligned common blocks, runs of lines that follow each other in both documents, with at least MIN_BLOCK characters
go from the later document.

What the longest common order leaves out stays: a block that the earlier document has in another place of the order
is no aligned block, and of a line that the later document repeats more often no more occurrences go than the
partner has. Blocks for which there is another partner are aligned with that one.

Defined cases: a null text has no lines; blank lines go only inside a block; a text with fewer than MIN_BLOCK
characters in all stays; a null doc_id is later than all others; rows that tie on doc_id are ordered by a hash of the
text, and equal rows among them are one document, all of which keep or lose the same lines; lines repeated within one
document only stay; a very long text is one task's work, in proportion to its lines and the stretches that it shares;
an empty table gives no rows. All columns of the input stay as they are; those of the result that would clash with one
get underscores in front.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters below which a common block stays.
MIN_BLOCK = 40


def _unique(values: list[int], low: int, high: int) -> dict[int, int]:
    at, twice = {}, set()
    for k in range(low, high):
        v = values[k]
        if v in at:
            twice.add(v)
        at[v] = k
    for v in twice:
        del at[v]
    return at


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) whose second numbers increase: patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, v) in enumerate(pairs):
        pile = bisect_left(tops, v)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            ends.append(k)
        else:
            tops[pile], ends[pile] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _numbered(values: list[int], low: int, high: int) -> dict[tuple[int, int], int]:
    """Places of the first, second, ... occurrence of each value."""
    seen: dict[int, int] = {}
    at = {}
    for k in range(low, high):
        v = values[k]
        seen[v] = seen.get(v, 0) + 1
        at[v, seen[v]] = k
    return at


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal elements (position in a, position in b) by patience diff."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            found.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            found.append((ah, bh))
        if al == ah or bl == bh:
            continue
        for places in (_unique, _numbered):
            in_a, in_b = places(a, al, ah), places(b, bl, bh)
            anchors = _increasing(sorted((i, in_b[v]) for v, i in in_a.items() if v in in_b))
            if anchors:
                break
        if anchors:
            found += anchors
            edges = [(al - 1, bl - 1), *anchors, (ah, bh)]
            todo += [(i + 1, j, k + 1, m) for (i, k), (j, m) in zip(edges, edges[1:]) if j > i + 1 and m > k + 1]
    return sorted(found)


def blocks(early: list[int], late: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """Line ranges (start, end) of ``late`` that are aligned with lines that follow each other in ``early`` and hold MIN_BLOCK characters."""
    out = []
    start, size, last = 0, 0, (-2, -2)
    for i, j in [*align(early, late), (-2, -2)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if size >= MIN_BLOCK:
                out.append((start, last[1] + 1))
            start, size = j, 0
        if j >= 0:
            size += sizes[j]
        last = i, j
    return out


_LAST = (1 << 63) - 1
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def windows(hashes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shortest runs of lines that reach MIN_BLOCK: (document, start, end, hash) of the run from each line on and of that up to each line.

    ``offsets`` are the documents' bounds in ``hashes`` and ``sizes``. Sorted by document and start.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low, high, at = offsets[doc], offsets[doc + 1], np.arange(len(hashes))
    ends = np.searchsorted(total, total[at] + MIN_BLOCK)
    starts = np.searchsorted(total, total[at + 1] - MIN_BLOCK, side="right") - 1
    forth, back = ends <= high, starts >= low
    spans = np.unique(np.stack([np.concatenate([at[forth], starts[back]]), np.concatenate([ends[forth], at[back] + 1])]), axis=1)
    # powers of an odd number and of its inverse make a run's hash independent of its place
    up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(hashes), _ODD, np.uint64)), dtype=np.uint64)
    down = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(hashes), _BACK, np.uint64)), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * down[: len(hashes)], dtype=np.uint64)])
    start, end = spans
    return doc[start], start - offsets[doc[start]], end - offsets[doc[start]], ((sums[end] - sums[start]) * up[start]).view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    return column.flatten().to_numpy(zero_copy_only=False), bounds


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc, window, start, end) of every window."""
    for batch in batches:
        (hashes, offsets), (sizes, _) = _flat(batch.column(2)), _flat(batch.column(3))
        doc, start, end, window = windows(hashes, sizes, offsets)
        own = pa.array(doc)
        columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(window), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "window", "start", "end"])


_CUT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, cut) of each pair out of (row, first, late, sizes, early): the stretches of both documents, ``first`` the place of the later one's."""
    for batch in batches:
        cut = []
        for first, late, sizes, early in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            cut.append([{"start": first + s, "end": first + e} for s, e in blocks(early, late, sizes)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, _CUT)], names=["row", "cut"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, cut) with ranges that overlap or touch put together."""
    for batch in batches:
        out = []
        for ranges in batch.column(1).to_pylist():
            merged: list[list[int]] = []
            for start, end in sorted((r["start"], r["end"]) for r in ranges):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            out.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _CUT)], names=["row", "cut"])


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with line_count, line_removed and line_kept (the text without the removed lines)."""
    row = F.xxhash64("doc_id", "text")
    split = docs.where(F.length("text") >= MIN_BLOCK).select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), _lines(F.col("text")).alias("lines"))
    hashed = split.select("row", "doc", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.length(F.trim(x))).alias("sizes"))
    # equal rows are one document
    single = common.materialize(hashed.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc", "hashes", "sizes"))), "line-hashes")
    carried = common.materialize(single.select("row", "doc", "hashes", "sizes").mapInArrow(_carried, "row long, doc long, window long, start int, end int"), "windows")
    # doc and row, in this order, say which document is earlier
    each = carried.groupBy("window").agg(F.min(F.struct("doc", "row", "start")).alias("first"), F.max(F.struct("doc", "row")).alias("last"), F.count("*").alias("n"))
    each = each.where(F.struct("first.doc", "first.row") != F.col("last")).select("window", F.col("first.doc").alias("early_doc"), F.col("first.row").alias("early"), F.col("first.start").alias("place"), "n")
    met = common.spread_join(carried, common.materialize(each, "shared"), "window", "row")
    later = (F.col("doc") > F.col("early_doc")) | ((F.col("doc") == F.col("early_doc")) & (F.col("row") > F.col("early")))
    # the stretch of either document that the windows of the pair span
    spans = [F.min("start").alias("start"), F.max("end").alias("end"), F.min("place").alias("early_start"), F.max(F.col("place") + F.col("end") - F.col("start")).alias("early_end")]
    pairs = common.materialize(met.where(later).groupBy("row", "early").agg(*spans), "pairs")
    partners = pairs.groupBy("early").agg(F.count("*").alias("n")).join(single.select(F.col("row").alias("early"), F.col("hashes").alias("early_hashes")), "early")
    stretch = lambda column, start, end: F.slice(column, F.col(start) + 1, F.col(end) - F.col(start))
    paired = common.spread_join(pairs, partners, "early", "row").withColumn("early_hashes", stretch("early_hashes", "early_start", "early_end"))
    both = paired.join(single.select("row", "hashes", "sizes"), "row").select("row", F.col("start").alias("first"), stretch("hashes", "start", "end").alias("late"), stretch("sizes", "start", "end").alias("sizes"), "early_hashes")
    cut_of = "row long, cut array<struct<start:int,end:int>>"
    cuts = both.mapInArrow(_align, cut_of).where(F.size("cut") > 0).groupBy("row").agg(F.flatten(F.collect_list("cut")).alias("cut")).mapInArrow(_merge, cut_of)

    own = docs.columns
    key, cut_key, cut, lines = common.fresh(own, "line_row", "line_cut_row", "line_cut", "line_all")
    counted, removed, kept = common.fresh(own, "line_count", "line_removed", "line_kept")
    joined = docs.withColumn(key, row).join(cuts.select(F.col("row").alias(cut_key), F.col("cut").alias(cut)), F.col(key) == F.col(cut_key), "left").withColumn(lines, _lines(F.col("text")))
    # what lies before each range that goes, and behind the last
    edges = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["end"])), F.concat(F.transform(cut, lambda r: r["start"]), F.array(F.size(lines))), lambda s, e: F.slice(lines, s + 1, e - s))
    gone = F.coalesce(F.aggregate(cut, F.lit(0), lambda n, r: n + r["end"] - r["start"]), F.lit(0)).cast("long")
    left = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(edges), "\n"))
    return joined.select(*own, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counted), gone.alias(removed), left.alias(kept))
