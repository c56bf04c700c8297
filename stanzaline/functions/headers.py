"""Headers of printed books as column expressions: reference heads, chapter and verse heads, running heads, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .refs import books, roman
from .text import squeeze, strip_tags

#: Books of one chapter, whose heads leave it out.
SINGLE = ["Obadiah", "Philemon", "2 John", "3 John", "Jude"]
_NUMERAL = "[ivxlcj]+"


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _book(name: Column) -> Column:
    name = F.initcap(F.lower(squeeze(name)))
    return F.when(name == "Psalm", "Psalms").otherwise(name)


def head_reference(x: Column, default_book: Column | None = None) -> Column:
    """``MATTHEW 23:29-39``, ``13:34-14:2`` (the book from before) or ``Jude 1-2`` as a struct of book, sc, sv, ec, ev, else null."""
    x = F.translate(F.regexp_replace(F.trim(x), r"\.$", ""), "–—", "--")
    full = r"^(?:((?:[123] )?[A-Za-z][A-Za-z .']*?) +)?(?:Chapter +)?([0-9]{1,3}):([0-9]{1,3})(?: *- *([0-9]{1,3})(?::([0-9]{1,3}))?)?$"
    short = r"^((?:[123] )?[A-Za-z]+) +([0-9]{1,3})(?: *- *([0-9]{1,3}))?$"
    n = lambda p, g: _part(x, p, g).cast("int")
    book = F.coalesce(_book(_part(x, full, 1)), default_book if default_book is not None else F.lit(None).cast("string"))
    crossing = n(full, 5).isNotNull()
    pack = lambda b, *v: F.struct(b.alias("book"), *(c.alias(k) for c, k in zip(v, ("sc", "sv", "ec", "ev"))))
    one = _book(_part(x, short, 1))
    return F.when(x.rlike(short) & one.isin(SINGLE), pack(one, F.lit(1), n(short, 2), F.lit(1), F.coalesce(n(short, 3), n(short, 2)))).when(
        x.rlike(full) & book.isNotNull(), pack(book, n(full, 2), n(full, 3), F.when(crossing, n(full, 4)).otherwise(n(full, 2)), F.coalesce(n(full, 5), n(full, 4), n(full, 3)))
    )


def running_head(line: Column) -> Column:
    """Chapter of a running head (``CHAP. IV. 1-3. 57``): short, ends in a page number, holds no words of a title."""
    pattern = rf"(?i)^chap[.,]\s+({_NUMERAL})\b.{{0,40}}?\s[0-9]{{1,4}}\s*$"
    rest = F.regexp_replace(line, rf"(?i)^chap[.,]\s+{_NUMERAL}\b", "")
    chapter = roman(_part(line, pattern, 1), lenient=True)
    return F.when((F.length(line) <= 70) & line.rlike(pattern) & ~rest.rlike("[A-Za-z]{3,}") & (chapter <= 150), chapter)


def chapter_head(line: Column) -> Column:
    """``Chap. ii. 4-iv. 26. Title`` or ``PSALM I.`` as a struct of sc, sv, ec, ev, title; null for prose that cites a chapter."""
    line = squeeze(line)
    psalm = rf"(?i)^psalm ({_NUMERAL})\.? ?(.*)$"
    head = rf"(?i)^(?:chap|ohap|jihap)[.,] ({_NUMERAL})\b\.? ?(?:([0-9]+) ?(?:[-x] ?(?:({_NUMERAL})\. ?)?([0-9]+))?)?\.?(.*)$"
    n = lambda g: _part(line, head, g).cast("int")
    title = F.trim(F.regexp_extract(line, head, 5))
    sc, ec = roman(_part(line, head, 1), lenient=True), roman(_part(line, head, 3), lenient=True)
    cited = title.rlike(r"^[,;)\]]") | title.rlike(r"^(?!sq|ff)[a-z]\S* \S+ \S+") | title.rlike(r"^[0-9]{1,4}$")
    pack = lambda a, b, c, d, t: F.struct(a.alias("sc"), b.alias("sv"), c.alias("ec"), d.alias("ev"), t.alias("title"))
    ps = roman(_part(line, psalm, 1), lenient=True)
    return F.when(line.rlike(psalm), pack(ps, F.lit(1), ps, F.lit(None).cast("int"), F.trim(F.regexp_extract(line, psalm, 2)))).when(
        line.rlike(head) & sc.isNotNull() & ~cited, pack(sc, F.coalesce(n(2), F.lit(1)), F.coalesce(ec, sc), F.coalesce(n(4), n(2)), title)
    )


def verse_head(line: Column) -> Column:
    """``Ver. 1.``, ``Vers. 1, 2.``, ``Vers. 7 sq.`` as a struct of sv, ev, rest; a verse number above 176 is none."""
    pattern = r"^(?:Vers?|Vens)\.\s+([0-9]+)\s*(?:(?:[,xX-]\s*([0-9]+))|sqq?\.?)?\s*\.?\s*(.*)$"
    low = _part(line, pattern, 1).cast("int")
    return F.when(line.rlike(pattern) & (low <= 176), F.struct(low.alias("sv"), F.coalesce(_part(line, pattern, 2).cast("int"), low).alias("ev"), F.trim(F.regexp_extract(line, pattern, 3)).alias("rest")))


def intro_title(title: Column) -> Column:
    """``THE FIRST BOOK OF SAMUEL 2``, ``II KINGS 3 & 4``, ``RUTH l`` as a struct of book, chapter, to_chapter; book null if unknown."""
    t = squeeze(title)
    two, one, ell = r"^(.*?) ([0-9]+) & ([0-9]+)$", r"^(.*?) ([0-9]+)\.?$", r"^(.*?) [lI]$"
    chapter = F.when(t.rlike(two), _part(t, two, 2).cast("int")).when(t.rlike(one), _part(t, one, 2).cast("int")).when(t.rlike(ell), 1)
    name = F.when(t.rlike(two), F.regexp_extract(t, two, 1)).when(t.rlike(one), F.regexp_extract(t, one, 1)).when(t.rlike(ell), F.regexp_extract(t, ell, 1)).otherwise(t)
    n = F.regexp_replace(F.upper(name), ",.*$", "")
    for old, new in (("^THE ", ""), ("BOOK OF ", ""), ("(GENERAL )?EPISTLE OF (PAUL TO )?(THE )?", ""), ("^FIRST ", "1 "), ("^SECOND ", "2 "), ("^THIRD ", "3 "), ("^III ", "3 "), ("^(II|H) ", "2 "), ("^I ", "1 "), (r"\bKING$", "KINGS"), (r"^NUMBER$", "NUMBERS"), ("^PSALM$", "PSALMS"), ("^REVELATIONS$", "REVELATION"), ("^SONG OF SOLOMON$", "SONG OF SONGS")):
        n = F.regexp_replace(n, old, new)
    upper = F.create_map(*[F.lit(v) for b in books() for v in (b.upper(), b)])
    return F.struct(upper[F.trim(n)].alias("book"), chapter.alias("chapter"), _part(t, two, 3).cast("int").alias("to_chapter"))


def summary_ranges(x: Column) -> Column:
    """Array of (s, e) for each ``v. 1-7``, ``v. 16, 17`` or ``vv. 3-5`` of a summary, from the first number to the last; ``ver.`` is not read."""
    found = F.regexp_extract_all(x, F.lit(r"v{1,2}\.\s*([0-9]+(?:\s*[–,-]\s*[0-9]+)*)"), F.lit(1))
    numbers = F.transform(found, lambda m: F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda v: v.cast("int")))
    return F.transform(numbers, lambda v: F.struct(F.element_at(v, 1).alias("s"), F.element_at(v, -1).alias("e")))


def leading_verse(x: Column) -> Column:
    return _part(x, '^\\s*([0-9]+)\\s+[A-Z"“]', 1).cast("int")


def tei_lines(x: Column) -> Column:
    """Text of an encoded entry: title out, a line for each paragraph, other tags off, blanks squeezed, no empty lines."""
    x = F.regexp_replace(x, r"(?s)<title[^>]*>.*?</title>", "")
    x = strip_tags(F.regexp_replace(x, r"</?p[^>]*>|<lb ?/>", "\n"))
    return F.regexp_replace(x, "\n+", "\n")
