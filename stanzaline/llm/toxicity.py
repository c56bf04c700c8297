"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: letters lose their case and accents, look-alikes of other scripts become the Latin
letters that they imitate, digits and signs inside words the letters that they stand for. A term matches at
the beginning of a word, as a whole word or, if it is a stem, with any ending. Words inside an exception phrase
do not count. The score is a logistic function of the matched weight for each word of the text.

The lexicon, the exception phrases and the weights are learned from a bounded sample of the labelled rows that
are not held out: a term is a word, or the beginning of words, whose rate in toxic texts is far above that in
others, even at the lower end of its confidence interval, and its weight is the logarithm of that ratio; an exception is such a word with a neighbour
with which it is common in texts that are not toxic.

Defined cases: a null or empty text holds no term and has the score of no match; repeated rows score alike;
unlabelled and conflicting labels teach nothing, of several texts of one labelled doc_id the least does, and
equal texts teach once; a null doc_id has no label; a very long text is scored whole; without labels of both
classes every score is 0.5, and without any term the share of toxic texts; labels, lang, source and doc_id are
never inputs of a score; an empty table gives no rows; the score's name gets underscores in front where a
column has it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

THRESHOLD = 0.5
#: Labelled documents that a fit takes at most of class 0 and of class 1, by hash of doc_id, and their bytes of text.
MAX_PER_CLASS, MAX_BYTES = (8_000, 4_000), 32 << 20
#: Terms that a lexicon holds at most, best first, and characters of a term.
MAX_TERMS, SHORTEST, LONGEST = 2_000, 3, 24
#: Toxic texts that a term must be found in; errors by which the lower end of an interval lies below the value; least lower end of a rate ratio (e to the power of MARGIN).
SUPPORT, ERRORS, MARGIN = 3, 2.0, 1.1
#: Terms with which a toxic text counts as explained.
COVER = 3
#: Words that are added to a text's length in the feature that short texts do not dominate.
SHORT = 50
#: Texts that are not toxic in which a phrase is an exception.
EXCEPTION_SUPPORT = 3

# Letters of other scripts and signs that look like Latin letters, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "æ": "ae", "œ": "oe", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
#: l and i are one letter, since 1 and | stand for both.
MERGED = {"l": "i"}

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f]")
#: A sign stands for a letter between letters, @ and $ also before one.
_SIGN = re.compile(r"(?<=[^\W_])[!|€£](?=[^\W_])|[@$](?=[^\W_])")
_LATIN = str.maketrans({**LOOKALIKES, **DIGITS, **MERGED})
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text in the alphabet of the lexicon."""
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    return _SIGN.sub(lambda m: SIGNS[m[0]], text).translate(_LATIN)


@dataclass
class Lexicon:
    """Weights of terms (a blank at the end: whole words; none: stems), exception phrases, and the logistic function."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        """Patterns of the terms and of the exception phrases (weight None), all to begin at the beginning of a word."""
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, True))
        for term, weight in self.terms.items():
            bare = term.rstrip(" ")
            known = found.get(bare, None)
            if known is None or known[1] is not None and known[1] < weight:
                found.add_word(bare, (len(bare), weight, term != bare))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, float]]:
    """(start, weight) of every word that a term matches outside of exception phrases; the heaviest term counts."""
    best: dict[int, float] = {}
    spans: list[tuple[int, int]] = []
    if automaton is None or not folded:
        return []
    for last, (size, weight, ends) in automaton.iter(folded):
        start, end = last - size + 1, last + 1
        if start and folded[start - 1].isalnum() or ends and end < len(folded) and folded[end].isalnum():
            continue
        if weight is None:
            spans.append((start, end))
        elif weight > best.get(start, -math.inf):
            best[start] = weight
    if spans:
        spans.sort()
        at, reach = 0, -1
        kept = {}
        for start in sorted(best):
            while at < len(spans) and spans[at][0] <= start:
                reach = max(reach, spans[at][1])
                at += 1
            if start >= reach:
                kept[start] = best[start]
        best = kept
    return sorted(best.items())


def features(folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """The matched weight for each word of the text, and each of a text that is SHORT words longer, on logarithmic scales."""
    weight = sum(w for _, w in matches(folded, automaton))
    if not weight:
        return 0.0, 0.0
    words = max(1, sum(1 for _ in _WORD.finditer(folded)))
    return math.log1p(100 * weight / words), math.log1p(100 * weight / (words + SHORT))


def score(lexicon: Lexicon, text: str | None, automaton: ahocorasick.Automaton | None) -> float:
    """Of one text, from 0 to 1."""
    x = features(fold(text or ""), automaton)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, lexicon.offset + lexicon.slopes[0] * x[0] + lexicon.slopes[1] * x[1]))))


def candidates_of(folded: str) -> Counter:
    """Terms that the text would match, and how many words each matches: every word, and the beginnings of words."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(folded)).items():
        if len(word) >= SHORTEST:
            if len(word) <= LONGEST:
                out[word + " "] += n
            for k in range(SHORTEST, min(len(word), LONGEST) + 1):
                out[word[:k]] += n
    return out


@dataclass
class Seen:
    """What is known of a term: texts, occurrences, and sums of squared occurrences in a text, toxic and not."""

    texts: int
    bad: int
    bad_squares: int
    good: int
    good_squares: int


def rate_ratio(seen: Seen, bad_words: int, good_words: int) -> tuple[float, float]:
    """Logarithm of the term's rate in toxic texts by that in others, and the lower end of its interval.

    A text, not a word, is what the interval counts as one observation.
    """
    bad, good = seen.bad + 0.5, seen.good + 0.5
    value = math.log(bad / (bad_words + 1)) - math.log(good / (good_words + 1))
    return value, value - ERRORS * math.sqrt((seen.bad_squares + 0.5) / bad**2 + (seen.good_squares + 0.5) / good**2)


def phrases_of(folded: str, starts: Iterable[int]) -> set[str]:
    """The words at the places, each with the word before it and with that behind it."""
    words = [(m.start(), m[0]) for m in _WORD.finditer(folded)]
    at = {start: k for k, (start, _) in enumerate(words)}
    out = set()
    for k in (at[s] for s in starts if s in at):
        out.update(" ".join(w for _, w in words[a : a + 2]) for a in (k - 1, k) if 0 <= a < len(words) - 1)
    return out


def choose(known: dict[str, Seen], texts: list[tuple[str, int]]) -> dict[str, float]:
    """Terms by the evidence that they bring, each found in enough toxic texts that have fewer than COVER of those before it."""
    words = [0, 0]
    for folded, y in texts:
        words[y] += sum(1 for _ in _WORD.finditer(folded))
    ranked = []
    for term, seen in known.items():
        value, low = rate_ratio(seen, words[1], words[0])
        if seen.texts >= SUPPORT and low >= MARGIN:
            # of terms with the same matches the longest stem comes first, and a stem before the same whole word
            ranked.append((-seen.bad * low, -len(term.rstrip(" ")), term, value))
    ranked.sort()
    where: dict[str, list[int]] = {term: [] for _, _, term, _ in ranked}
    for k, (folded, y) in enumerate(texts):
        if y:
            for term in candidates_of(folded).keys() & where.keys():
                where[term].append(k)
    covered, out, begun = Counter(), {}, set()
    for _, _, term, value in ranked:
        if len(out) == MAX_TERMS:
            break
        bare = term.rstrip(" ")
        # the words of a chosen stem, and all that begin like a chosen term, are spoken for
        if bare in begun or any(bare[:k] in out for k in range(SHORTEST, len(bare) + 1)):
            continue
        if sum(covered[k] < COVER for k in where[term]) >= SUPPORT:
            out[term] = value
            begun.update(bare[:k] for k in range(SHORTEST, len(bare) + 1))
            covered.update(where[term])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients of the columns and of a constant, by Newton's method; slopes below zero are set to zero."""
    x = np.column_stack([x, np.ones(len(x))])
    b, used = np.zeros(x.shape[1]), list(range(x.shape[1]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x[:, used] @ b[used], -30, 30)))
        g = x[:, used].T @ (p - y) + ridge * b[used]
        h = (x[:, used] * (p * (1 - p))[:, None]).T @ x[:, used] + ridge * np.eye(len(used))
        b[used] -= np.linalg.solve(h, g)
        if (b[:-1] < 0).any() and len(used) > 1:
            used = [k for k in used if k == x.shape[1] - 1 or b[k] > 0]
            b = np.where(np.isin(np.arange(len(b)), used), b, 0.0)
    return b


def fit(known: dict[str, Seen], texts: list[tuple[str, int]]) -> Lexicon:
    """A lexicon of (folded text, label) pairs; known: the candidate terms."""
    toxic = sum(y for _, y in texts)
    if not 0 < toxic < len(texts):
        return Lexicon({})
    lexicon = Lexicon(choose(known, texts))
    automaton = lexicon.automaton()
    seen: dict[str, list[int]] = {}
    for folded, y in texts:
        for phrase in phrases_of(folded, [s for s, _ in matches(folded, automaton)]):
            seen.setdefault(phrase, [0, 0])[y] += 1
    share = toxic / len(texts)
    lexicon.exceptions = {p for p, (clean, bad) in seen.items() if clean >= EXCEPTION_SUPPORT and bad < share * (clean + bad)}
    automaton = lexicon.automaton()
    x = np.array([features(folded, automaton) for folded, _ in texts])
    *slopes, lexicon.offset = (float(v) for v in _logistic(x, np.array([y for _, y in texts], float)))
    lexicon.slopes = (slopes[0], slopes[1])
    return lexicon


def is_held_out(doc_id):
    """Rows that no fit may learn from: crc32 of the doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["term", "texts", "bad", "bad_squares", "good", "good_squares"]
    for batch in common.slices(batches, 64):
        seen: dict[str, list[int]] = {}
        for folded, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term, n in candidates_of(folded).items():
                row = seen.setdefault(term, [0, 0, 0, 0, 0])
                row[0] += y
                row[1 if y else 3] += n
                row[2 if y else 4] += n * n
        columns = [pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(5))]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 64):
        folded = [fold(t or "") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), batch.column(1)], names=["text", "y"])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_per_class: tuple[int, int] = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Lexicon:
    """A lexicon of a bounded, hash-ordered sample of the labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~is_held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("y"), F.max(column).alias("most")).where("y = most")
    sample: dict[int, int] = {}
    for y in (1, 0):
        for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class[y]).select("doc_id").collect():
            sample[r["doc_id"]] = y
    if not sample:
        return Lexicon({})
    spark = docs.sparkSession
    labelled = spark.createDataFrame(sorted(sample.items()), "doc_id long, y int")
    # a row of the sample is 12 bytes, and their number is bounded by max_per_class
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labelled), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y")).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    one = common.materialize(one.select("doc_id", "text", "y"), "labelled")
    sizes = one.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, taken = max_bytes, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["doc_id"],))
    part = one.join(F.broadcast(spark.createDataFrame(taken, "doc_id long")), "doc_id").select("text", "y")
    folded = common.materialize(part.mapInArrow(_folded, "text string, y int"), "folded")
    numbers = ["texts", "bad", "bad_squares", "good", "good_squares"]
    counted = folded.mapInArrow(_candidates, "term string, " + ", ".join(f"{c} long" for c in numbers)).groupBy("term").agg(*(F.sum(c).alias(c) for c in numbers))
    texts = sorted((r["text"], r["y"]) for r in folded.collect())
    # no more than the best by a measure that needs no totals, far above what a lexicon holds
    often = counted.where(F.col("texts") >= SUPPORT).orderBy(F.desc(F.col("bad") * F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5))), "term").limit(50 * MAX_TERMS)
    return fit({r["term"]: Seen(*(r[c] for c in numbers)) for r in often.collect()}, texts)


def score_documents(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text; one pass, no shuffle."""
    at, fields, (name,) = docs.columns.index("text"), docs.schema, common.fresh(docs.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in common.slices(batches, 64):
            scores = [score(lexicon, t, automaton) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*fields.fields, StructField(name, DoubleType())]))
