"""Ordered, stateful algorithms: chains, number recovery, alignment, trigger sections.

Each runs on one ordered group at a time (a source file, a book, an office); groups are the unit of
distribution, and their rows are fed in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CONFUSED


def longest_chain(keys: Sequence) -> list[int]:
    """Positions of a longest non-decreasing subsequence."""
    tops, ends, back = [], [], []
    for i, key in enumerate(keys):
        pile = bisect_right(tops, key)
        back.append(ends[pile - 1] if pile else None)
        tops[pile : pile + 1], ends[pile : pile + 1] = [key], [i]
    out, i = [], ends[-1] if ends else None
    while i is not None:
        out.append(i)
        i = back[i]
    return out[::-1]


def per_group(df: DataFrame, group: list[str], order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Grouped map whose input is sorted by ``order``."""
    return df.groupBy(*group).applyInPandas(lambda part: _plain(run(part.sort_values(order, kind="stable").reset_index(drop=True))), schema)


def _plain(out: pd.DataFrame) -> pd.DataFrame:
    """Columns without rows as objects: their own kind, a number, does not become a text."""
    return out if len(out) else out.astype(object)


def listed(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """One row for each group with its (k, v) in order, for steps on very many small groups."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(value).alias("v")))).alias(out))


def keep_chain(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Rows of each group's longest non-decreasing chain of keys."""
    return per_group(df, group, order, lambda part: part.iloc[longest_chain(part[key].tolist())], df.schema.simpleString()[7:-1])


#: Short words that are no misread numbers.
COMMON_WORDS = frozenset("is as at to of in on up us we he she it the and for".split())


def misread(token: str, number: int) -> int | None:
    """Characters of a token that stand for a digit of the number that they look like, two at most; null if it cannot be the number."""
    digits = str(number)
    costs = [0 if seen == digit else 1 if digit in CONFUSED.get(seen, "") else 3 for seen, digit in zip(token, digits)]
    return sum(costs) if len(token) == len(digits) and sum(costs) <= 2 else None


def recover_numbers(tokens: Sequence[str], top: int, gaps: Sequence[tuple[int, int]] = (), near: int = 5, far: int = 15, window: int = 50, anchored: bool = False) -> list[tuple[int, int, bool]]:
    """Headings that carry a rising number, out of scanned tokens: (position, number, corrected). The simple machine.

    The number nearest to the expected one is taken; it may be up to ``near`` further on with confused
    digits, or ``far`` further on without. Known gaps are jumped. With ``anchored`` a short token that is no
    common word takes the expected number where the one after it follows exactly. Other tokens are passed over.
    """
    found, want = [], 1
    for at, token in enumerate(tokens):
        if want > top:
            break
        behind = next((end + 1 for start, end in gaps if start <= want <= end + 1 and misread(token, end + 1) is not None), None)
        readings = ((n - want, cost) for n in range(want, min(top, want + window) + 1) if (cost := misread(token, n)) is not None)
        ahead, cost = next(readings, (window + 1, 0)) if behind is None else (behind - want, 1)
        if behind is None and ahead > near and (ahead > far or cost):
            follows = at + 1 < len(tokens) and tokens[at + 1] == str(want + 1)
            if not (anchored and follows and 2 <= len(token) <= 4 and token.lower() not in COMMON_WORDS):
                continue
            ahead, cost = 0, 1
        found.append((at, want + ahead, behind is not None or cost + ahead > 0))
        want += ahead + 1
    return found


def best_start(tokens: Sequence[str], top: int, **options) -> int:
    """The place to start from that recovers the most numbers, the first on a tie; only tokens that may be 1 count."""
    starts = [i for i, t in enumerate(tokens) if misread(t, 1) is not None] or [0]
    return max(starts, key=lambda i: (len(recover_numbers(tokens[i:], top, **options)), -i))


def number_headings(df: DataFrame, group: str, order: str, token: str, gaps: Sequence[tuple[int, int]] = (), anchored: bool = False) -> DataFrame:
    """(group, order, number, corrected) of the headings that the simple machine recovers in each group, up to the largest number that is readable as it stands."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tokens = part[token].tolist()
        top = max((int(t) for t in tokens if t.isascii() and t.isdigit()), default=0)
        start = best_start(tokens, top, gaps=gaps, anchored=anchored) if tokens else 0
        rows = recover_numbers(tokens[start:], top, gaps, anchored=anchored)
        at = [start + i for i, _, _ in rows]
        return pd.DataFrame({group: part[group].iloc[at].values, order: part[order].iloc[at].values, "number": [n for _, n, _ in rows], "corrected": [c for _, _, c in rows]})

    kinds = dict(df.dtypes)
    return per_group(df, [group], [order], run, f"{group} {kinds[group]}, {order} {kinds[order]}, number long, corrected boolean")


def ordered_words(phrase: Sequence[str], verse: Sequence[str], start: int = 0) -> tuple[str, int]:
    """(strong, weak or none, position after the last word found) of a phrase in a verse."""
    at, hits = start, 0
    for word in phrase:
        try:
            at = verse.index(word, at) + 1
            hits += 1
        except ValueError:
            continue
    n = len(phrase)
    return ("strong" if n and hits == n else "weak" if hits >= 2 and 2 * hits >= n else "none"), at


def align_phrases(phrases: Sequence[Sequence[str]], verses: Sequence[Sequence[str]], ahead: int = 12, is_note: Callable[[Sequence[str]], bool] = lambda p: len(p) > 30) -> list[tuple[int, str]]:
    """(verse number from 1, strength) of each phrase, never going back.

    A strong match moves the cursor behind it, a weak one does not; a number alone moves to that verse; a
    note stays where the cursor is; what matches nothing is dropped (verse 0).
    """
    cursor, place, out = 1, 0, []
    for phrase in phrases:
        if len(phrase) == 1 and phrase[0].isdigit() and cursor <= int(phrase[0]) <= len(verses):
            cursor, place = int(phrase[0]), 0
            out.append((cursor, "anchor"))
            continue
        window = range(cursor, min(cursor + ahead, len(verses) + 1))
        matches = [(v, *ordered_words(phrase, verses[v - 1], place if v == cursor else 0)) for v in window]
        strong = next(((v, end) for v, kind, end in matches if kind == "strong"), None)
        weak = next((v for v, kind, _ in matches if kind == "weak"), None)
        if strong:
            cursor, place = strong
            out.append((cursor, "strong"))
        elif is_note(phrase):
            out.append((cursor, "note"))
        else:
            out.append((weak, "weak") if weak else (0, "dropped"))
    return out


def trigger_sections(texts: Sequence[str], triggers: Sequence[tuple[str, str]]) -> list[str]:
    """A section for each text: a trigger at or after the cursor that begins a text opens its section; the cursor never goes back."""
    cursor, section, out = 0, "", []
    for text in texts:
        hit = next((i for i in range(cursor, len(triggers)) if text.lower().startswith(triggers[i][0])), None)
        if hit is not None:
            cursor, section = hit + 1, triggers[hit][1]
        out.append(section)
    return out


def align_to_verses(phrases: DataFrame, verses: DataFrame, group: list[str], phrase_order: str, verse_order: str, words: str = "words", **options) -> DataFrame:
    """Phrase rows with the verse of their group that they belong to (null: none) and the strength of the match.

    Phrases and verses of a group (a chapter) meet in one row; many groups go to Python at once.
    """
    kinds = dict(phrases.dtypes)
    kept = [*group, phrase_order]
    names = [f"g{i}" for i in range(len(group))]
    sides = [listed(df, group, order, words, side).withColumnsRenamed({c: f"{side}_{n}" for c, n in zip(group, names)}) for df, order, side in ((phrases, phrase_order, "left"), (verses, verse_order, "right"))]
    same = reduce(lambda a, b: a & b, (F.col(f"left_{n}").eqNullSafe(F.col(f"right_{n}")) for n in names))
    met = sides[0].join(sides[1], same, "left").select(*(F.col(f"left_{n}").alias(n) for n in names), "left", "right")
    found = "array<struct<at: int, strength: string>>"

    @F.pandas_udf(found)
    def aligned(left: pd.Series, right: pd.Series) -> pd.Series:
        texts = lambda own: [list(r["v"]) for r in own] if own is not None else []
        return pd.Series([[{"at": v, "strength": k} for v, k in align_phrases(texts(a), texts(b), **options)] for a, b in zip(left, right)], dtype=object)

    each = met.withColumn("found", aligned("left", "right")).select(*names, "right", F.inline(F.arrays_zip(F.col("left.k").alias("k"), F.col("found"))))
    verse = F.when(F.col("found.at") > 0, F.get("right.k", F.col("found.at") - 1)).cast("long")
    return each.select(*(F.col(n).alias(c) for n, c in zip(names, group)), F.col("k").cast(kinds[phrase_order]).alias(phrase_order), verse.alias("verse"), F.col("found.strength").alias("strength"))


def classify_blocks(blocks: Sequence[str]) -> list[tuple[str, str]]:
    """(kind, sidenote) of page blocks: headings, cues, rubrics, sidenotes (given to the next block) and texts."""
    pending, out = "", []
    for block in blocks:
        body = block.strip()
        if body.startswith("[") and body.endswith("]"):
            pending = body[1:-1]
            continue
        letters = [c for c in body if c.isalpha()]
        if letters and all(c.isupper() for c in letters):
            kind = "heading"
        elif body.startswith(("V.", "R.", "Minister.", "Answer.", "People.")):
            kind = "cue"
        elif body.startswith(("_", "''")) or body.startswith("¶"):
            kind = "rubric"
        else:
            kind = "text"
        out.append((kind, pending))
        pending = ""
    return out
