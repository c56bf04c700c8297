"""Embedding near-dedup by E8 lattice hashing.

Unit vectors are projected at random to two blocks of eight dimensions, in several tables, and each
block is decoded to the nearest point of the lattice E8; the two points are the vector's cell. Each
vector also probes the cells that it lies nearest to, made of neighbouring points in either block. Two
blocks keep chance meetings rare: their share of all pairs is the square of what one block would have. Vectors that share a cell in some table are compared by cosine in double
precision, in blocks, and a pair is counted in the first cell that it shares.

Defined cases: a vector that is null, zero, or holds a null or a component that is not finite is linked
with nothing; vectors of different lengths never link; equal vectors are one node that counts for all
its rows; a null vec_id is never the least of a component that has another; an empty table gives no
rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SIMILAR = 0.95
TABLES, PROBES, SCALE, SEED = 8, 2, 1.3, 8_008
PARTS = 2
#: Rows of a block; a cell of more rows is compared block against block.
BLOCK = 1024
_EVEN = np.array([2, 3, 5, 7, 11, 13, 17, 19], np.int64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers of an even sum): round, and if the sum is odd, the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by a half in every coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def _roots() -> np.ndarray:
    """The 240 least vectors of E8, which lead to the neighbouring cells."""
    found = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    found.append(v)
    signs = (np.arange(256)[:, None] >> np.arange(8) & 1) * 2.0 - 1
    return np.array(found + [s / 2 for s in signs if (s < 0).sum() % 2 == 0])


_ROOTS = _roots()


def cells(units: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell keys (vector x tables x (1 + probes) ** PARTS): per block the nearest lattice point and the neighbours nearest to the vector."""
    dim = units.shape[1]
    out = np.zeros((len(units), tables, (1 + probes) ** PARTS), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, dim, t])
        keys = np.zeros((len(units), 1), np.uint64)
        for part in range(PARTS):
            x = units @ rng.standard_normal((dim, 8)) / scale + rng.random(8)
            home = decode_e8(x)
            # |x - home - r|^2 is least where (x - home) . r is largest, as all roots have one length
            lean = (x - home) @ _ROOTS.T
            best = np.argpartition(-lean, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
            points = np.concatenate([home[:, None], home[:, None] + _ROOTS[best]], 1)
            own = _keys(points, dim, t * PARTS + part)
            keys = ((keys[:, :, None] * np.uint64(0x9E3779B97F4A7C15)) ^ own[:, None, :]).reshape(len(units), -1)
        out[:, t] = keys.view(np.int64)
    return out


def _keys(points: np.ndarray, dim: int, place: int) -> np.ndarray:
    key = np.full(points.shape[:-1], (dim << 8 | place) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(8):
        key = (key ^ np.rint(points[..., k] * 2).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def _usable(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    if not (np.isfinite(top) and top > 0):
        return None
    x = x / top  # squares of very large or small components would leave the range
    return x / np.sqrt((x * x).sum())


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_size: dict[int, tuple[list, list]] = {}
        for node, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (unit := _usable(values)) is not None:
                nodes, units = by_size.setdefault(len(unit), ([], []))
                nodes.append(node)
                units.append(unit)
        for nodes, units in by_size.values():
            keys = cells(np.array(units)).reshape(len(units), -1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "cells"])


def _compare(similar: float):
    def run(table: pa.Table) -> pa.Table:
        """Weighted link counts and a spanning forest of the links of one cell's two blocks."""
        cell = table.column("cell")[0].as_py()
        node, weight = np.array(table.column("node")), np.array(table.column("weight"))
        side = np.array(table.column("side"))
        units = np.array([_usable(v) for v in table.column("vector").to_pylist()])
        n = len(node)
        seen: dict[int, list[int]] = {}
        for k, own in enumerate(table.column("cells").to_pylist()):
            for c in own:
                if c < cell:
                    seen.setdefault(c, []).append(k)
        close = units @ units.T >= similar
        np.fill_diagonal(close, False)
        if table.column("x")[0].as_py() != table.column("y")[0].as_py():
            close &= side[:, None] != side
        for rows in {tuple(r) for r in seen.values() if len(r) > 1}:
            close[np.ix_(rows, rows)] = False  # counted in an earlier cell
        links = close @ weight
        hit = np.flatnonzero(links)
        # a forest by sweeps from each row not yet reached
        edges, reached = [], np.zeros(n, bool)
        for start in hit:
            if not reached[start]:
                reached[start] = True
                front = [start]
                while front:
                    at = front.pop()
                    fresh = np.flatnonzero(close[at] & ~reached)
                    reached[fresh] = True
                    edges += [(node[at], node[f]) for f in fresh]
                    front += fresh.tolist()
        a = [*node[hit], *(e[0] for e in edges)]
        b = [*([None] * len(hit)), *(e[1] for e in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*links[hit], *([0] * len(edges))], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    e = F.col("embedding")
    good = F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    node = F.when(good, F.xxhash64(F.transform(e, lambda x: x.cast("double") + F.lit(0.0))))
    rows = vectors.select(F.col("vec_id").cast("long"), node.alias("node"), F.col("embedding").cast("array<double>").alias("vector"))
    nodes = common.materialize(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "nodes")
    celled = common.materialize(nodes.select("node", "vector").mapInArrow(_cell_rows, "node long, cells array<long>"), "cells")
    flat = celled.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    shared = flat.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("members"), F.min("node").alias("low")).where("n > 1")
    # cells with the same members say the same: the least stands for them
    shared = shared.groupBy("n", "members", "low").agg(F.min("cell").alias("cell"))
    member = common.materialize(common.spread_join(flat, common.materialize(shared.select("cell", "n"), "shared"), "cell", "node"), "member")
    own = member.groupBy("node").agg(F.collect_list("cell").alias("cells"))  # at most as many as probed
    full = nodes.join(own, "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = member.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cell", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    found = dealt.join(full, "node").select("cell", "x", "y", "side", "node", "weight", "cells", "vector").groupBy("cell", "x", "y").applyInArrow(_compare(similar), "a long, b long, links long")
    found = common.materialize(found, "links")
    part = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    where = nodes.select("node", "vec_id", "weight").join(part, "node", "left").select("node", "vec_id", "weight", F.coalesce("component", "node").alias("component"))
    least = where.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    where = where.join(least, "component").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(where, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
