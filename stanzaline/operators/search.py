"""Tokens, stems, limits and snippets of full-text search; ``search_index`` stores and searches them.

A token is a run of letters and digits, in lower case and without marks on Latin letters; words of
three letters and more are stemmed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

K1, B = 1.2, 0.75
#: What a term adds that most documents hold: less than any rarer one.
LEAST_IDF = 1e-6
SNIPPET_TOKENS = 12
#: Marks that combine with the letter before them are part of its word.
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{300}-\x{331}]*"


def _bare_letters() -> dict[str, str]:
    """Small Latin letters with a single mark, and the letters without it."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(chr(code).lower()) == 1 and len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            found[chr(code).lower()] = parts[0]
    return found


_MARKED = _bare_letters()


def fold(text) -> Column:
    """Lower case, without marks; letters are looked up only where there are others than ASCII."""
    low = F.lower(text)
    bare = F.regexp_replace(F.translate(low, "".join(_MARKED), "".join(_MARKED.values())), r"[\x{300}-\x{331}]+", "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), bare).otherwise(low)


def tokens_of(text) -> Column:
    """Folded tokens of a text in their order, not stemmed; a null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def terms_of(query: str) -> list[str]:
    """Stems of a query's alphanumeric terms, all of which must match; an empty query is an error."""
    found = re.findall("[A-Za-z0-9]+", query or "")
    if not found:
        raise ValueError("the query is empty without punctuation")
    return [porter(t.lower()) for t in found]


def checked_limit(limit: int | None = None) -> int:
    """How many hits a search returns: 20 where nothing is said, 1 to 100 may be asked for."""
    if limit is None:
        return 20
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit


_WORDS = re.compile("(?:[^\\W_]+[\u0300-\u0331]*)+")
_ASCII_WORDS = re.compile("[a-z0-9]+")


_BARE = str.maketrans({**_MARKED, **{chr(code): None for code in range(0x300, 0x332)}})
#: The same for arrays of characters; 0 is for none.
_BARE_CODES = np.array([ord(_BARE[code] or "\0") if code in _BARE else code for code in range(max(_BARE) + 1)], "<u4")


def _folded(word: str) -> str:
    return porter(word.lower().translate(_BARE))


def best_window(hits: list[tuple[int, int]], size: int, width: int, heads: list[int] = ()) -> int:
    """The first token of the best window of ``width`` tokens in a text of ``size``.

    ``hits`` are (token, term). Every term that a window holds counts 1000, every further hit 1; a window
    begins at a hit and is moved so that its hits lie in its middle, or begins at the head of the sentence
    of a hit, which counts 100, and 120 at the text's own head. The first of the best wins.
    """
    best, found = -1, 0

    def worth(start):
        inside = [(at, t) for at, t in hits if start <= at < start + width]
        terms = len({t for _, t in inside})
        return 1000 * terms + len(inside) - terms, inside

    for at, _ in hits:
        score, inside = worth(at)
        if score > best:
            first, last = inside[0][0], inside[-1][0] + 1
            best, found = score, max(0, min(first - (width - (last - first)) // 2, size - width))
        if heads and size > width:
            head = max((h for h in heads if h <= at), default=heads[0])
            if head < at:
                score = worth(head)[0] + (100 if head else 120)
                if score > best:
                    best, found = score, head
    return found


def snippet_of(text: str | None, stems: list[str], width: int = SNIPPET_TOKENS) -> str | None:
    """The best window of a text, hits in ``<em>``, dots where text is left out; null where nothing is hit."""
    known = {t: i for i, t in enumerate(stems)}
    return snippet_at(text, [(k, known[w]) for k, m in enumerate(_WORDS.finditer(text or "")) if (w := _folded(m[0])) in known], width)


def snippet_at(text: str | None, hits: list[tuple[int, int]], width: int = SNIPPET_TOKENS) -> str | None:
    """The best window of a text in which (token, term) are hit."""
    spans = [m.span() for m in _WORDS.finditer(text or "")]
    if not hits:
        return None
    # a sentence begins behind a stop or a colon and blanks
    heads = [k for k, (s, _) in enumerate(spans) if not k or re.search(r"[.:]\s*\Z", text[spans[k - 1][1] : s])]
    start = best_window(hits, len(spans), width, heads)
    end = start + width
    out, at = [], spans[start][0] if start else 0
    for k in sorted({k for k, _ in hits if start <= k < end}):
        low, high = spans[k]
        out += [text[at:low], "<em>", text[low:high], "</em>"]
        at = high
    out.append(text[at:] if end >= len(spans) else text[at : spans[end - 1][1]] + "...")
    return ("..." if start else "") + "".join(out)


_VOWELS = set("aeiou")
_LETTER_KINDS = bytes(ord("v" if chr(code) in _VOWELS else "c") for code in range(256))


def _kinds(stem: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    if "y" not in stem and stem.isascii():
        return stem.encode().translate(_LETTER_KINDS).decode()
    out = ""
    for c in stem:
        out += "v" if c in _VOWELS or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    if "y" not in stem and stem.isascii():
        return stem.encode().translate(_LETTER_KINDS).count(b"vc")
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _short_end(stem: str) -> bool:
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


# Suffixes of the published stemmer's second, third and fourth steps.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


_TABLES = tuple({old: new for old, _, new in (p.partition(":") for p in table.split())} for table in (_STEP2, _STEP3))
_REMOVED = dict.fromkeys(_STEP4.split(), "")


def _by_end(endings: dict[str, str]) -> dict[str, list[str]]:
    """Suffixes by their last two letters, the longest first; most words end in others."""
    return {end: sorted((old for old in endings if old.endswith(end)), key=len, reverse=True) for end in {old[-2:] for old in endings}}


_TABLES_BY_END = tuple((table, _by_end(table)) for table in _TABLES)
_REMOVED_BY_END = _by_end(_REMOVED)
#: Words that end in none of these letters or pairs are their own stems.
_LETTERS_THAT_GO = frozenset("sdgye")
_PAIRS_THAT_GO = frozenset(("ll", *_REMOVED_BY_END, *(end for _, ends in _TABLES_BY_END for end in ends)))


def _longest_end(word: str, endings: dict[str, list[str]]) -> str:
    for old in endings[word[-2:]]:
        if word.endswith(old):
            return old
    return ""


def porter(word: str) -> str:
    """The stem of a lower-case word by the 1980 algorithm, with the two later departures of its author.

    Most words end in letters that a step has nothing for, so each step looks at these first.
    """
    if not 3 <= (len(word) if word.isascii() else len(word.encode())) <= 64:
        return word
    if word[-1] not in _LETTERS_THAT_GO and word[-2:] not in _PAIRS_THAT_GO:
        return word
    w = word
    if w[-1] == "s":
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    end = w[-1:]
    if end == "d" and w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif end == "d" or end == "g":
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if cut is not None and _has_vowel(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in _VOWELS and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w[-1:] == "y" and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in _TABLES_BY_END:
        if w[-2:] in ends and (old := _longest_end(w, ends)):
            w = w[: -len(old)] + table[old] if _measure(w[: -len(old)]) > 0 else w
    if w[-2:] in _REMOVED_BY_END and (old := _longest_end(w, _REMOVED_BY_END)):
        stem = w[: -len(old)]
        if _measure(stem) > 1 and (old != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w[-1:] == "e":
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Words whose stems a worker remembers.
REMEMBERED = 400_000
_stems: dict[str, str] = {}


def _stem(word: str) -> str:
    if (found := _stems.get(word)) is None:
        if len(_stems) >= REMEMBERED:
            _stems.clear()
        found = _stems[word] = porter(word)
    return found


def words_in(text: str | None) -> list[str]:
    """Words of a text in lower case, whose stems are its terms."""
    low = (text or "").lower()
    return (_ASCII_WORDS if low.isascii() else _WORDS).findall(low)


#: Characters of one or two bytes have one small form each, of two bytes at most; but for those that are cut by ``words_in``.
_LATIN, _NOT_SO = 0x250, "".join(c for c in map(chr, range(0x250)) if len(c.lower().encode()) > 2 or len(c.lower()) > 1)
#: By two bytes: whether the first is in a word. A byte below 128 says so alone, the two of a longer character together.
_IN_WORD = np.zeros((256, 256), bool)
for _c in map(chr, range(0x800)):
    if _WORDS.fullmatch(_c):
        _b = _c.encode()
        _IN_WORD[_b[0], _b[1] if len(_b) > 1 else slice(None)] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_in`` of all texts, one after the other, and how many each text has; Latin texts are cut at once."""
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, f"[{_NOT_SO}\\x{{{_LATIN:x}}}-\\x{{10ffff}}]")).as_py():
        found = [words_in(t) for t in texts.to_pylist()]
        return pa.array([w for own in found for w in own], pa.string()), np.array([len(own) for own in found], np.int64)
    low = pa.concat_arrays([pc.utf8_lower(texts).cast(pa.string())])  # from its first byte
    ends, data = np.frombuffer(low.buffers()[1], np.int32)[: len(low) + 1], np.frombuffer(low.buffers()[2] or b"", np.uint8)
    data = data[ends[0] : ends[-1]]
    inside = _IN_WORD[data, np.r_[data[1:], np.uint8(0)]]
    second = np.flatnonzero(data >= 0xC0) + 1
    inside[second] = inside[second - 1]
    begins = inside & ~np.r_[False, inside[:-1]]
    heads = (ends[:-1] - ends[0])[np.diff(ends) > 0]
    begins[heads] = inside[heads]
    # places of the words' heads among the bytes of words
    at = np.flatnonzero(begins[inside])
    offsets = np.r_[at, inside.sum()].astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    before = np.r_[0, np.cumsum(begins)]
    return words, np.diff(before[ends - ends[0]])


@lru_cache(REMEMBERED // 2)
def stem_of(word: str) -> str:
    """The term of one of ``words_in``."""
    return porter(word) if word.isascii() else _folded(word)


def stems_of(words: list[str]) -> list[str]:
    """``stem_of`` each of the words; marks are taken off all of them at once."""
    odd = [k for k, w in enumerate(words) if not w.isascii()]
    if odd:
        words = list(words)
        # a line for each word, as none holds a line's end
        codes = np.frombuffer("\n".join([words[k] for k in odd]).lower().encode("utf-32-le"), "<u4")
        bare = np.where(codes < len(_BARE_CODES), _BARE_CODES[np.minimum(codes, len(_BARE_CODES) - 1)], codes)
        for k, word in zip(odd, bare[bare > 0].tobytes().decode("utf-32-le").split("\n")):
            words[k] = word
    return [porter(w) if w[-1:] in _LETTERS_THAT_GO or w[-2:] in _PAIRS_THAT_GO else w for w in words]


def stems_in(text: str | None) -> list[str]:
    """Stems of a text's tokens in their order."""
    return [stem_of(w) for w in words_in(text)]


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems of words."""
    return words.map(_stem, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    """Stems of arrays of words."""
    return words.map(lambda own: [_stem(w) for w in own], na_action="ignore")
