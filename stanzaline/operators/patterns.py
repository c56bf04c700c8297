"""Many literal patterns in many texts: one Aho-Corasick pass over each text, whatever the number of patterns.

Patterns are a table. Their distinct texts are sent to the executors and built into an automaton once in each Python
worker, which reads Arrow batches; no pattern is paired with a text that does not hold it. A set whose texts have more than
``MOST_BYTES`` is dealt by a hash into parts below that size, and every text is read once for each part.

Occurrences may overlap. With ``inside`` given, one counts only if neither neighbour is among these characters
(whole words, if they are the letters). Places are code points.

Defined cases: null and empty patterns occur nowhere, repeated ones are one; null and empty texts hold none; very
long texts are searched whole, their hits sent on in parts; rows are not told apart, so repeated rows count again; empty
tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of pattern texts in one automaton, as UTF-8, at most (about; parts are dealt by a hash).
MOST_BYTES = 8 << 20
#: Hits in one Arrow batch.
HITS = 65_536
LETTERS = "abcdefghijklmnopqrstuvwxyz"

_built: dict[int, ahocorasick.Automaton] = {}


def _automaton(sent) -> ahocorasick.Automaton:
    """The automaton of a broadcast set: built by the first task of a worker that asks, the last one asked for stays."""
    if sent.id not in _built:
        _built.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in sent.value:
            made.add_word(p)
        made.make_automaton()
        _built[sent.id] = made
    return _built[sent.id]


class _Sent:
    """A broadcast set and a number to know it by in the worker."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def _found(made: ahocorasick.Automaton, text: str, inside: frozenset) -> Iterator[tuple[int, int]]:
    """(start, end) of each hit, end exclusive."""
    for last, size in made.iter(text):
        start, end = last + 1 - size, last + 1
        if inside and (start and text[start - 1] in inside or end < len(text) and text[end] in inside):
            continue
        yield start, end


def _parts(patterns: DataFrame, column: str, most: int) -> list[_Sent]:
    spark = patterns.sparkSession
    own = patterns.select(F.col(column).alias("p")).where("p <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    count = -(-size // most)
    out = []
    for k in range(count):
        # the texts of a part, below the size that was just checked, about
        texts = [r.p for r in own.where(F.pmod(F.xxhash64("p"), F.lit(count)) == k).collect()]
        if texts:
            sent = spark.sparkContext.broadcast(sorted(texts))
            out.append(_Sent(sent, sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)))
    return out


def counts(docs: DataFrame, text: str, patterns: DataFrame, pattern: str, inside: str = "", most: int = MOST_BYTES) -> DataFrame:
    """(pattern, n_texts, n_hits) of patterns that occur: added up in each batch, then by Spark."""
    near = frozenset(inside)
    schema = "pattern string, n_texts long, n_hits long"

    def over(sent: _Sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made, texts, hits = _automaton(sent), Counter(), Counter()
                for value in batch.column(0):
                    t = value.as_py() or ""
                    own = Counter(t[s:e] for s, e in _found(made, t, near))
                    texts.update(own.keys())
                    hits.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), pa.array([texts[p] for p in hits], pa.int64()), pa.array(hits.values(), pa.int64())], names=["pattern", "n_texts", "n_hits"])

        return docs.select(text).mapInArrow(run, schema)

    return _union([over(s) for s in _parts(patterns, pattern, most)], docs, schema).groupBy("pattern").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_hits").alias("n_hits"))


def hits(docs: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, inside: str = "", most: int = MOST_BYTES) -> DataFrame:
    """(key, pattern, start, end) of every occurrence; the key has another name than these."""
    near = frozenset(inside)
    kind = docs.select(key).schema[0].dataType
    schema = f"`{key}` {kind.simpleString()}, pattern string, start int, end int"

    def over(sent: _Sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made, keys, spans = _automaton(sent), batch.column(0), []

                def packed() -> pa.RecordBatch:
                    rows, words, starts, ends = zip(*spans)
                    return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(words), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "pattern", "start", "end"])

                for row, value in enumerate(batch.column(1)):
                    t = value.as_py() or ""
                    for s, e in _found(made, t, near):
                        spans.append((row, t[s:e], s, e))
                        if len(spans) == HITS:
                            yield packed()
                            spans.clear()
                if spans:
                    yield packed()

        return docs.select(key, text).mapInArrow(run, schema)

    return _union([over(s) for s in _parts(patterns, pattern, most)], docs, schema)


def _union(frames: list[DataFrame], docs: DataFrame, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else docs.sparkSession.createDataFrame([], schema)
