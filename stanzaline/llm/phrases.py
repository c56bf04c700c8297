"""Phrase collocation mining by pivot partitioning.

Texts are cut into pieces at punctuation and pieces into words. The pivot of an n-gram is its rarest word
(the leftmost, if several are as rare). Every occurrence of a word is rewritten to a fragment: the word with
up to LONGEST - 1 neighbours on either side, as far as they are not rarer than it. Fragments are routed to
their pivot, where the n-grams that it owns are counted; so each occurrence of an n-gram is counted in one
place, once. Rarity comes from a table of PAGES x PAGE counters of hashed words whose size does not follow
the corpus: any order of the words gives the same counts, and words that no frequent phrase can hold are
left out only where their counter proves it. N-grams of pivots that are very frequent are routed by
themselves, as sums of one task's occurrences, so no pivot is a hot key.

Defined cases: a null or empty text has no words; a null lang is ``und``; repeated rows count each time; a
very long text is worked on in parts that end at punctuation; other columns, of any names and values, are
not read; an empty table gives no rows; phrases that tie on score and count are ordered by their bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LONGEST = 3
MIN_COUNT = 10
TOP = 2000
#: A phrase goes when a longer candidate that holds it has at least this many hundredths of its count.
COVERED = 50
NO_LANG = "und"
#: Counters of hashed words, in pages that tasks fill.
PAGES, PAGE = 256, 1 << 16
#: Pivots with more occurrences, and more than the HOT_SHARE-th part of all words, are hot, and those beyond HOT_MOST in any case.
HOT_LEAST, HOT_SHARE, HOT_MOST = 4_000, 2_000, 500_000
#: Characters of text that a task works on at once.
CHUNK = 8 << 20
#: Steps of the rarity scale for each doubling of a count.
_STEPS = 6
#: Parts of a language's phrases that are ranked by themselves before the final ranking.
_PARTS = 64

_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x09, 0x20]] = 1
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end at punctuation, so that no phrase is cut."""
    at = 0
    while len(text) - at > size:
        breaks = np.flatnonzero(_KINDS[np.frombuffer(text, np.uint8, size, at)] == 2)
        end = at + int(breaks[-1]) + 1 if len(breaks) else 0
        if not end:  # a piece longer than a part stays whole
            later = np.flatnonzero(_KINDS[np.frombuffer(text, np.uint8, offset=at)] == 2)
            end = at + int(later[0]) + 1 if len(later) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text) with the texts of a language joined by line ends, about ``size`` bytes at once."""
    held: dict[str, list[bytes]] = {}
    weight = 0
    for batch in common.slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _parts(text, size):
                held.setdefault(lang, []).append(part)
                weight += len(part)
                if weight >= size:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, weight = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, code of each word, number of each word's piece)."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    kinds = _KINDS[data]
    inner = kinds == 0
    starts = np.flatnonzero(inner & np.concatenate([[True], ~inner[:-1]]))
    ends = np.flatnonzero(inner & np.concatenate([~inner[1:], [True]])) + 1
    pieces = np.cumsum(kinds == 2, dtype=np.int64)[starts]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inner])])
    coded = pc.dictionary_encode(found)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces


def _slot(lang: bytes, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang)) & (PAGES * PAGE - 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, slot, n) of each chunk."""
    for lang, text in _chunks(batches, CHUNK):
        names, codes, _ = words_of(text)
        slots = np.fromiter((_slot(lang.encode(), w) for w in names.to_pylist()), np.int32, len(names))
        columns = [pa.array([lang] * len(names), pa.string()), names.cast(pa.string()), pa.array(slots), pa.array(np.bincount(codes, minlength=len(names)))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "slot", "n"])


def level(count: np.ndarray) -> np.ndarray:
    """Steps of rarity: 0 below MIN_COUNT, then _STEPS for each doubling, up to 255."""
    return np.where(count < MIN_COUNT, 0, np.minimum(255, 1 + np.floor(_STEPS * np.log2(np.maximum(count, MIN_COUNT) / MIN_COUNT)))).astype(np.uint8)


def _page(rows: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(PAGE, np.int64)
    counts[rows["slot"].to_numpy() % PAGE] = rows["n"].to_numpy()
    return pd.DataFrame({"page": [int(rows["slot"].iloc[0]) // PAGE], "levels": [level(counts).tobytes()]})


def _levels(words: DataFrame) -> np.ndarray:
    """The level of every counter: PAGES rows of PAGE bytes, whatever the corpus."""
    slots = words.groupBy("slot").agg(F.sum("n").alias("n")).groupBy(F.floor(F.col("slot") / PAGE))
    out = np.zeros(PAGES * PAGE, np.uint8)
    for r in slots.applyInPandas(_page, "page long, levels binary").collect():
        out[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(r["levels"], np.uint8)
    return out


def _moved(values: np.ndarray, by: int, empty: int) -> np.ndarray:
    """The values of the words that stand ``by`` places later."""
    out = np.full_like(values, empty)
    if by > 0:
        out[:-by] = values[by:]
    else:
        out[-by:] = values[:by]
    return out


def _glued(*columns: pa.Array, by: bytes = b"") -> pa.Array:
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(by, pa.large_binary()))


def _named(names: pa.Array, codes: np.ndarray, before: bytes = b"", behind: bytes = b"") -> pa.Array:
    """The words of the codes with something before and behind; nothing for code -1."""
    known = names
    if before or behind:
        known = _glued(pa.array([before] * len(names), names.type), names, pa.array([behind] * len(names), names.type))
    return pa.concat_arrays([known, pa.array([b""], names.type)]).take(pa.array(np.where(codes < 0, len(names), codes)))


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the columns (codes from -1 to 2^31), sorted, and how often each stands there."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _rows(lang: str, keys: pa.Array, bodies: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), keys.cast(pa.string()), bodies.cast(pa.string())], names=["lang", "key", "body"])


def _fragments(lang: str, text: bytes, levels: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """(lang, key, body): a pivot with its contexts, or an n-gram (blanks in the key) with its count.

    A context is the words before the pivot, a tab, the words behind it; line ends divide contexts. No word
    holds any of these characters.
    """
    names, codes, pieces = words_of(text)
    slots = np.fromiter((_slot(lang.encode(), w) for w in names.to_pylist()), np.int64, len(names))
    rarity = (levels[slots].astype(np.int64) << 32 | slots)[codes] if len(names) else codes
    own = rarity >> 32
    sides: dict[int, np.ndarray] = {}
    for way in (-1, 1):
        going = own > 0
        for by in range(1, LONGEST):
            there = _moved(rarity, way * by, -1)
            going = going & (_moved(pieces, way * by, -1) == pieces) & (there > rarity if way < 0 else there >= rarity)
            sides[way * by] = np.where(going, _moved(codes, way * by, -1), -1)
    mine = (sides[-1] >= 0) | (sides[1] >= 0)
    places = [-by for by in range(LONGEST - 1, 0, -1)] + list(range(1, LONGEST))
    usual = np.flatnonzero(mine & (own < hot))
    if len(usual):
        usual = usual[np.argsort(codes[usual], kind="stable")]
        pivot, context = codes[usual], [sides[p][usual] for p in places]
        half = LONGEST - 1
        before = [_named(names, c, behind=b" " if k < half - 1 else b"") for k, c in enumerate(context[:half])]
        behind = [_named(names, c, before=b" " if k else b"") for k, c in enumerate(context[half:])]
        contexts = _glued(*before, pa.array([b"\t"] * len(pivot), names.type), *behind)
        at = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(pivot)), pa.int32()), contexts)
        yield _rows(lang, names.take(pa.array(pivot[at])), pc.binary_join(lists, pa.scalar(b"\n", names.type)))
    often = np.flatnonzero(mine & (own >= hot))
    if len(often):
        line = {0: codes[often]} | {p: sides[p][often] for p in places}
        for size in range(2, LONGEST + 1):
            for first in range(1 - size, 1):
                gram = [line[p] for p in range(first, first + size)]
                whole = np.all([c >= 0 for c in gram], axis=0)
                if whole.any():
                    grams, n = _distinct([c[whole] for c in gram])
                    yield _rows(lang, _glued(*(_named(names, g) for g in grams), by=b" "), pa.array(n).cast(pa.string()))


def mine(bodies: list[str], pivot: str) -> Counter:
    """Counts of at least MIN_COUNT of the n-grams that the pivot owns, out of its contexts."""
    contexts: Counter = Counter()
    for body in bodies:
        contexts.update(body.split("\n"))
    found: Counter = Counter()
    if contexts.total() < MIN_COUNT:
        return found
    for context, n in contexts.items():
        before, _, behind = context.partition("\t")
        left, right = before.split(" ") if before else [], behind.split(" ") if behind else []
        line, at = [*left, pivot, *right], len(left)
        for start in range(at + 1):
            for end in range(max(at + 1, start + 2), min(len(line), start + LONGEST) + 1):
                found[" ".join(line[start:end])] += n
    return Counter({k: n for k, n in found.items() if n >= MIN_COUNT})


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) out of rows sorted by lang and key: one pivot's rows are held at a time."""
    at, bodies, out = None, [], []

    def close() -> None:
        lang, key = at
        if " " in key:
            n = sum(map(int, bodies))
            out.extend([(lang, key, n)] if n >= MIN_COUNT else [])
        else:
            out.extend((lang, phrase, n) for phrase, n in mine(bodies, key).items())

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"lang": a, "phrase": b, "n": n} for a, b, n in out], pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]))

    for batch in batches:
        for lang, key, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if at != (lang, key):
                if at:
                    close()
                at, bodies = (lang, key), []
            bodies.append(body)
        if len(out) > 10_000:
            yield table()
            out = []
    if at:
        close()
    yield table()


def count_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, n) of the phrases of 1 to LONGEST words with at least MIN_COUNT occurrences."""
    spark = docs.sparkSession
    texts = docs.where(F.length("text") > 0).select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, slot int, n long")
    words = common.materialize(counted.groupBy("lang", "word", "slot").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = int(level(np.array([min(max(HOT_LEAST, total // HOT_SHARE), HOT_MOST)]))[0]) + 1
    # of one size at every size of the corpus: PAGES * PAGE bytes
    levels: Broadcast = spark.sparkContext.broadcast(_levels(words).tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(levels.value, np.uint8)
        for lang, text in _chunks(batches, CHUNK):
            yield from _fragments(lang, text, known, hot)

    routed = texts.mapInArrow(cut, "lang string, key string, body string").repartition("lang", "key").sortWithinPartitions("lang", "key")
    single = words.where(F.col("n") >= MIN_COUNT).select("lang", F.col("word").alias("phrase"), "n")
    return words, common.materialize(single.unionAll(routed.mapInArrow(_mine, "lang string, phrase string, n long")), "phrases")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, known = count_phrases(docs)
    split = F.split("phrase", " ")
    candidates = known.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), split.alias("words"))
    # the parts of every cut, looked up in one join
    pieces = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(part, " ").alias("part")) for k in range(1, LONGEST) for side, part in ((0, F.slice("words", 1, k)), (1, F.slice("words", k + 1, LONGEST)))]
    parts = candidates.select("lang", "phrase", "a", F.inline(F.filter(F.array(*pieces), lambda p: p["k"] < F.size("words")))).withColumn("key", F.struct("lang", "part"))
    asked = parts.groupBy("lang", "part").agg(F.count("*").alias("n"))
    counted = asked.join(known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"]).select(F.struct("lang", "part").alias("key"), "n", "f")
    met = common.spread_join(parts.drop("part"), common.materialize(counted, "parts"), "key", "phrase")
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    cuts = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *(side(k, s).alias(f"f{k}{s}") for k in range(1, LONGEST) for s in (0, 1)))
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    scores = [F.when(F.col(f"f{k}0").isNotNull(), F.struct(_quotient(wide("a") * wide("a") * 1_000_000, wide(f"f{k}0") * wide(f"f{k}1")).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r"))) for k in range(1, LONGEST)]
    scored = cuts.select("lang", "phrase", "a", F.array_min(F.array(*scores)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = [(first, size) for size in range(2, LONGEST) for first in range(1, LONGEST - size + 2)]
    held = candidates.select("lang", "a", F.explode(F.array_distinct(F.filter(F.array(*(F.when(F.size("words") >= first + size - 1, F.array_join(F.slice("words", first, size), " ")) for first, size in inner)), lambda p: p.isNotNull()))).alias("phrase"), F.col("phrase").alias("longer"))
    longest = held.where(F.col("phrase") != F.col("longer")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("a")))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _quotient(a, b):
    """Whole part of the quotient of two decimals without a fraction, as a long."""
    return F.call_function("div", a, b)
