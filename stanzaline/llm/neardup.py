"""MinHash near-dedup of weighted word shingles by BagMinHash.

A document is a bag of five-word shingles. Each shingle's weight is discretised into dyadic intervals
[0, 1), [1, 2), [2, 4), ...; a Poisson process over time and weight, seeded by shingle and interval,
scatters points over the registers, and every register keeps its first point below the weight. The
interval that a weight ends in is thinned, so bags with different weights see nested points: two
registers agree with a probability equal to the weighted Jaccard similarity.

Registers are banded. Documents that share a band are checked by exact multiset overlap: every one
against its bucket's least document first. Where a bucket's documents are still in several components
after that, those outside its largest component are checked, in blocks, against all that lie in another
component than they. Copies of the same words are one node throughout.

Defined cases: a null or empty text (or one of blanks) has no shingles and is linked with nothing; a
text of one to four words is one shingle; very long texts are single bags, one in memory at a time where
signatures are made; of the rows of a group the one with the least doc_id, nulls last, and then the least
hash of doc_id and text is kept, so rows that tie on doc_id and rows without one are told apart; equal
rows are kept or not together; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .substrings import _P, _mix, _spans, word_hashes

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Documents of a block in pairwise checks.
BLOCK = 128
#: Documents that one task compares with the least of their bucket.
FAN = 512
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = np.arange(1, 65, dtype=np.uint64) * _GOLD
_UNIT = float(2.0**-53)
#: Expected points of a document for each register: enough that few documents need a second round.
_POINTS = float(np.log(REGISTERS) + 4)


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct word shingles of a text, and their counts."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64)
    size = min(WORDS, n)
    starts = np.arange(n - size + 1)
    return np.unique(_spans(words, starts, starts + size, _P), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (bag x REGISTERS, as 64-bit patterns of point times); empty bags have none, all ones."""
    out = np.full((len(bags), REGISTERS), np.inf)
    todo = np.array([k for k, b in enumerate(bags) if len(b[0])], np.int64)
    limit = {int(k): REGISTERS * _POINTS / float(bags[k][1].sum()) for k in todo}
    while len(todo):
        _scatter(bags, todo, limit, out)
        # a register that stayed empty needs a longer time; the points before it are the same
        todo = todo[np.isinf(out[todo]).any(1)]
        for k in todo:
            limit[int(k)] *= 2
            out[k] = np.inf
    return out.view(np.uint64)


def _scatter(bags, todo, limit, out) -> None:
    sizes = [len(bags[k][0]) for k in todo]
    owner = np.repeat(todo, sizes)
    item = np.concatenate([bags[k][0] for k in todo])
    weight = np.concatenate([bags[k][1] for k in todo]).astype(np.float64)
    until = np.repeat([limit[int(k)] for k in todo], sizes)
    level = 0
    while len(item):
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        inside = weight > low
        owner, item, weight, until = owner[inside], item[inside], weight[inside], until[inside]
        if not len(item):
            break
        _points(owner, _mix(item + _LEVELS[level]), weight - low, width, until, out)
        level += 1


def _points(owner, state, room, width, until, out) -> None:
    """The points of one dyadic interval, in the order of time, until each process passes its limit."""
    time = np.zeros(len(owner))
    flat = out.reshape(-1)
    while len(owner):
        state = state + _GOLD
        bits = _mix(state)
        time = time - np.log(_uniform(bits)) / width
        alive = time <= until
        owner, state, room, until, time, bits = owner[alive], state[alive], room[alive], until[alive], time[alive], bits[alive]
        if not len(owner):
            return
        # a second word of the same point: its register, and its place in the interval of weights
        more = _mix(bits ^ _GOLD)
        register = ((more >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        place = owner * REGISTERS + register
        if (room < width).any():
            below = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * (width / 4294967296.0) < room
            np.minimum.at(flat, place[below], time[below])
        else:
            np.minimum.at(flat, place, time)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every signature."""
    keys = np.zeros((len(registers), BANDS), np.uint64)
    for k in range(ROWS):
        keys = _mix(keys ^ registers[:, k::ROWS]) + _LEVELS[k]
    return _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)


#: Bytes of text whose signatures are made together.
_TOGETHER = 1 << 20


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        ids, rows, texts = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(ids):
            end, held = at, 0
            while end < len(ids) and held <= _TOGETHER:
                held += len(texts[end] or b"")
                end += 1
            bags = [shingles(t or b"") for t in texts[at:end]]
            keys = bands(signatures(bags)).view(np.int64)
            nodes = [_node(t) if len(b[0]) else None for t, b in zip(texts[at:end], bags)]  # equal words, equal node
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:end], pa.int64()), pa.array(rows[at:end], pa.int64()), pa.array(nodes, pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))], names=["doc_id", "row", "node", "bands"])
            at = end


def _node(text: bytes) -> int:
    """A text's words as a 64-bit number."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.split())) - (1 << 63)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), node (equal for equal words; null without words) and band keys of every row."""
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary"))
    return slim.mapInArrow(_sign, "doc_id long, row long, node long, bands array<long>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[int, tuple] = OrderedDict()

    def bag(node, text):
        if node not in known:
            known[node] = shingles(text)
            if len(known) > 64:
                known.popitem(last=False)
        return known[node]

    for batch in batches:
        hits = []
        for a, text_a, b, text_b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if overlap(shingles(text_a), bag(b, text_b)) >= SIMILAR:
                hits.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _check_block(table: pa.Table) -> pa.Table:
    """Links of one bucket's block of outsiders with a block of its members that lie in other components."""
    node, part, text, outside = (table.column(n).to_pylist() for n in ("node", "component", "text", "outside"))
    bags = [shingles(t) for t in text]
    total = [int(b[1].sum()) for b in bags]
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    members = [k for k, o in enumerate(outside) if not o]
    for i in (k for k, o in enumerate(outside) if o):
        for j in members:
            a, b = find(part[i]), find(part[j])
            if a != b and min(total[i], total[j]) >= SIMILAR * max(total[i], total[j]) and overlap(bags[i], bags[j]) >= SIMILAR:
                root[max(a, b)] = min(a, b)
                links.append((node[i], node[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _compare_least(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of (a, b, n): b, the least of a bucket of n, goes to as many tasks as its fan needs."""
    salts = F.greatest(F.ceil(F.col("n") / FAN), F.lit(1)).cast("int")
    fans = stars.groupBy("b").agg(F.max("n").alias("n")).select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    least = fans.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    others = stars.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int"))
    return others.join(least, ["b", "salt"]).select("a", "text_a", "b", "text_b").mapInArrow(_verify, "a long, b long")


def _compare_across(keyed: DataFrame, shared: DataFrame, part: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components of one bucket.

    Only documents outside a bucket's largest component are dealt anew, each in its block against all
    blocks of members: if they are few, every member is sent along once.
    """
    # buckets with the same members are one
    once = common.materialize(shared.groupBy("n", "members", "least").agg(F.min("band").alias("band")).where("n > 2"), "once")
    member = common.spread_join(keyed, once.select("band", "n"), "band", "node").join(part, "node", "left").select("band", "n", "node", F.coalesce("component", "node").alias("component"))
    member = common.materialize(member, "member")
    parts = member.groupBy("band", "n", "component").agg(F.count("*").alias("rows"))
    open_ = parts.groupBy("band", "n").agg(F.max(F.struct("rows", "component")).alias("top")).where("top.rows < n")
    open_ = common.materialize(open_.select("band", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.rows")).alias("out")), "open")
    member = common.spread_join(member.drop("n"), open_, "band", "node")
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), count(c)).cast("int")
    to_all = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    outside = member.where("component <> main").select("band", "node", "component", own("out").alias("x"), to_all("n").alias("y"), F.lit(True).alias("outside"))
    inside = member.select("band", "node", "component", to_all("out").alias("x"), own("n").alias("y"), F.lit(False).alias("outside"))
    dealt = outside.unionAll(inside).join(texts, "node")
    return dealt.groupBy("band", "x", "y").applyInArrow(_check_block, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row (its hash), group_id (least doc_id of the group), n_links and kept for every row.

    ``n_links`` counts the verified links of the row's words to other words that the groups were built
    from; copies are not counted.
    """
    signed = common.materialize(sign(docs), "signed")
    at = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(at).alias("at"), F.first("bands").alias("bands"))
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("members")).where("n > 1")
    shared = common.materialize(shared, "shared")
    stars = common.spread_join(keyed, shared, "band", "node").where("node <> least")
    stars = common.materialize(stars.groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.max("n").alias("n")), "stars")

    # texts of nodes in some bucket, each from the row that stands for it
    wanted = stars.select(F.col("a").alias("node")).unionAll(stars.select(F.col("b").alias("node"))).distinct()
    source = nodes.join(wanted, "node", "left_semi").select("node", F.col("at.row").alias("row"))
    found = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text")).join(source, "row")
    texts = common.materialize(found.dropDuplicates(["row"]).select("node", "text"), "texts")

    links = common.materialize(_compare_least(stars, texts), "links")
    rest = common.materialize(_compare_across(keyed, shared, components(links), texts), "links")
    links = links.unionAll(rest)
    part = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    where = nodes.select("node", "at").join(part, "node", "left").select("node", "at", F.coalesce("component", "node").alias("component"))
    least = where.groupBy("component").agg(F.min("at").alias("least"))
    where = where.join(least, "component").join(degree, "node", "left").select("node", F.col("least.doc_id").alias("group_id"), F.col("least.row").alias("least_row"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "row", "node").join(where, "node", "left")
    own = F.col("least_row").isNull()  # a row without words is a group by itself
    group = F.when(own, F.col("doc_id")).otherwise(F.col("group_id"))
    return out.select("doc_id", "row", group.alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (own | (F.col("least_row") == F.col("row"))).alias("kept"))
