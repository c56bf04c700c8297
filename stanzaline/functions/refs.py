"""The reference grammar: human-written passage references to validated spans, as column expressions.

A reference names a book and chapters or verses: ``Ps 23``, ``Genesis 1-2``, ``John 3:16-4:2``,
``Ps 23:1,3,5-7``. Books are found by alias, spans are checked against the bounds of the text they are
asked of; what cannot be read keeps its row, with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Books in canonical order and their abbreviations.
BOOKS = """
Genesis: gen, ge, gn
Exodus: ex, exo, exod
Leviticus: lev, le, lv
Numbers: num, nu, nm, nb
Deuteronomy: deut, de, dt
Joshua: josh, jos
Judges: judg, jdg, jg
Ruth: rth, ru
1 Samuel: 1sa, 1sm, 1sam
2 Samuel: 2sa, 2sm, 2sam
1 Kings: 1ki, 1kgs, 1kings
2 Kings: 2ki, 2kgs, 2kings
1 Chronicles: 1ch, 1chr, 1chron
2 Chronicles: 2ch, 2chr, 2chron
Ezra: ezr
Nehemiah: neh, ne
Esther: est, esth, es
Job: jb
Psalms: ps, psa, psalm, pslm
Proverbs: prov, pr, prv, pro
Ecclesiastes: eccl, ecc, ec, qoh, qohelet
Song of Songs: song, songs, song of solomon, canticles, sos, cant
Isaiah: isa, is
Jeremiah: jer, je
Lamentations: lam, la
Ezekiel: ezek, eze, ezk
Daniel: dan, da, dn
Hosea: hos, ho
Joel: jl
Amos: am
Obadiah: obad, obd, ob
Jonah: jon, jnh
Micah: mi, mic
Nahum: nah, na
Habakkuk: hab
Zephaniah: zeph, zep
Haggai: hag, hg
Zechariah: zech, zec, zc
Malachi: mal, ml
Matthew: matt, mt, mat
Mark: mk, mrk
Luke: lk, luk
John: jn, joh, jhn
Acts: ac, act
Romans: rom, ro, rm
1 Corinthians: 1cor, 1co
2 Corinthians: 2cor, 2co
Galatians: gal, ga
Ephesians: eph, ephes
Philippians: phil, php, phl
Colossians: col, co
1 Thessalonians: 1thess, 1thes, 1th
2 Thessalonians: 2thess, 2thes, 2th
1 Timothy: 1tim, 1ti
2 Timothy: 2tim, 2ti
Titus: tit, ti
Philemon: phlm, phm
Hebrews: heb, he
James: jas, jm
1 Peter: 1pet, 1pe, 1pt
2 Peter: 2pet, 2pe, 2pt
1 John: 1jn
2 John: 2jn
3 John: 3jn
Jude: jud, jd
Revelation: rev, re, apocalypse
Tobit: tob, tb
Judith: jdt
Wisdom: wis, ws
Sirach: sir, ecclesiasticus
Baruch: bar
1 Maccabees: 1ma, 1mac, 1macc, 1maccabees
2 Maccabees: 2ma, 2mac, 2macc, 2maccabees
"""


def books() -> list[str]:
    return [line.split(":")[0] for line in BOOKS.strip().splitlines()]


def alias_rows() -> list[tuple[str, str]]:
    """(alias, book), both the names themselves and the abbreviations, all lower case."""
    rows = []
    for line in BOOKS.strip().splitlines():
        name, _, short = line.partition(":")
        rows += [(a.strip(), name) for a in [name.lower(), *short.split(",")]]
    return rows


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, book string")


#: A number before a name: a digit, as an ordinal too, or i to iii before a blank; then the name.
_NUMBERED = r"^(?:([123])(?:st|nd|rd)?|(i{1,3})(?= ))? *(.*)$"


def fold_book(raw) -> Column:
    """Lower case, no dots, single blanks, a number before the name as a digit and a blank."""
    x = F.regexp_replace(F.replace(F.lower(F.trim(raw)), F.lit("."), F.lit("")), r"[ \t\r\n]+", " ")
    digit, ones, name = (F.regexp_extract(x, _NUMBERED, k) for k in (1, 2, 3))
    return F.trim(F.concat(F.when(digit != "", F.concat(digit, F.lit(" "))).when(ones != "", F.concat(F.length(ones).cast("string"), F.lit(" "))).otherwise(""), name))


def resolve_books(df: DataFrame, raw: str, names: DataFrame, out: str = "book") -> DataFrame:
    """Adds the book by alias, also with the blank after its number left out. ``names`` has a row for each alias."""
    first = names.select(F.col("alias").alias("_a1"), F.col("book").alias("_b1"))
    second = names.select(F.col("alias").alias("_a2"), F.col("book").alias("_b2"))
    folded = df.withColumn("_fold", fold_book(F.col(raw)))
    met = folded.join(first, F.col("_fold") == F.col("_a1"), "left").join(second, F.regexp_replace("_fold", "^([123]) ", "$1") == F.col("_a2"), "left")
    return met.withColumn(out, F.coalesce("_b1", "_b2")).drop("_fold", "_a1", "_b1", "_a2", "_b2")


SPAN = "struct<ch:bigint,vs:int,ve:int>"
_SPLIT = r"^(.+?)[ \t]+([0-9][0-9 \t:,-]*)$"


def _n(text, pattern: str, group: int, kind: str = "int") -> Column:
    return F.regexp_extract(text, pattern, group).try_cast(kind)


def split_reference(ref) -> tuple[Column, Column]:
    """Book part and number part, long dashes read as hyphens; both empty if there is no such split."""
    ref = F.translate(F.trim(ref), "–—", "--")
    return F.trim(F.regexp_extract(ref, _SPLIT, 1)), F.regexp_replace(F.regexp_extract(ref, _SPLIT, 2), "[ \t]", "")


def bounds_of(units: DataFrame) -> DataFrame:
    """(book, book_order, chapter, last): a row for each chapter with its last verse, in one aggregation."""
    per = units.groupBy("book", "chapter").agg(F.min("book_order").cast("int").alias("book_order"), F.max("verse_no").cast("int").alias("last"))
    return per.select("book", "book_order", F.col("chapter").cast("long").alias("chapter"), "last")


def within_chapters(units: DataFrame, refs: list[str]) -> DataFrame:
    """The units of the chapters that literal references name, as a filter that reaches the scan."""
    import re

    spans = set()
    for ref in refs:
        numbers = re.search(_SPLIT, ref.translate(str.maketrans("–—", "--")).strip())
        if numbers:
            found = re.sub(r"[ \t]", "", numbers[2])
            low = int(re.match(r"\d+", found)[0])
            high = re.search(r"-(\d+):\d+$", found) or (re.fullmatch(r"\d+-(\d+)", found))
            spans.add((low, int(high[1]) if high else low))
    where = F.lit(False)
    for low, high in sorted(spans):
        where = where | F.col("chapter").between(low, high)
    return units.where(where)


def parse_references(df: DataFrame, ref: str, names: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds book, book_order, spans (array of ch, vs, ve), display and error.

    Each different text is read once: its spans are unfolded to chapters, joined to ``bounds`` (rows of book,
    book_order, chapter, last) on book and chapter, and folded again. No side is broadcast by a hint, and
    no row holds more chapters than one reference names. Chapters without a bound are errors. Spans keep
    the order in which they are written.
    """
    asked = df.select(F.coalesce(F.col(ref), F.lit("")).alias("_ref")).distinct()
    raw, numbers = split_reference(F.col("_ref"))
    split = asked.select("_ref", raw.alias("_raw"), numbers.alias("_num"))
    tops = bounds.groupBy("book").agg(F.min("book_order").alias("book_order"), F.max("chapter").alias("_top"))
    met = resolve_books(split, "_raw", names, "book").join(tops, "book", "left")
    num, top = F.col("_num"), F.col("_top")
    cross, chapters, whole, verses = (num.rlike(p) for p in (r"^\d+:\d+-\d+:\d+$", r"^\d+-\d+$", r"^\d+$", r"^\d+:.+$"))
    span = lambda ch, vs, ve: F.struct(ch.cast("long").alias("ch"), vs.cast("int").alias("vs"), ve.cast("int").alias("ve"))
    sc = _n(num, r"^(\d+)", 1, "long")
    ec = F.when(cross, _n(num, r"-(\d+):", 1, "long")).when(chapters, _n(num, r"-(\d+)$", 1, "long")).otherwise(sc)
    sv, ev = _n(num, r"^\d+:(\d+)", 1), _n(num, r":(\d+)$", 1)
    # a span for each chapter, only where both ends are known to be in bounds; an end that is not written is the chapter's
    steps = F.when((sc >= 1) & (ec <= top) & (sc <= ec), F.sequence(sc, ec))
    over = F.transform(steps, lambda c: span(c, F.when(cross & (c == sc), sv).otherwise(1), F.when(cross & (c == ec), ev)))
    parts = F.split(F.regexp_extract(num, r"^\d+:(.+)$", 1), ",")
    listed = F.transform(parts, lambda p: span(sc, _n(p, r"^(\d+)", 1), F.coalesce(_n(p, r"^\d+-(\d+)$", 1), _n(p, r"^(\d+)$", 1))))
    spans = F.when(verses & ~cross, F.when((sc >= 1) & (sc <= top), listed)).otherwise(over)
    yes = lambda x: F.coalesce(x, F.lit(False))
    early = (
        F.when(F.trim("_ref") == "", "empty")
        .when(num == "", "unreadable")
        .when(top.isNull(), "unknown book")
        .when(~(cross | chapters | whole | verses), "unreadable")
        .when(verses & ~cross & yes(F.exists(parts, lambda p: ~p.rlike(r"^\d+(-\d+)?$"))), "unreadable")
        .when(~yes((sc >= 1) & (sc <= top) & (ec >= 1) & (ec <= top)), "chapter out of range")
        .when(yes(sc > ec), "inverted")
    )
    read = met.select("_ref", "book", "book_order", (verses & ~cross).alias("_listed"), early.alias("_early"), spans.alias("_spans"))
    each = read.where("_early is null").select("_ref", "book", F.posexplode("_spans").alias("_ix", "_span"))
    last = bounds.select("book", F.col("chapter").alias("_ch"), "last")
    bound = each.join(last.withColumnRenamed("book", "_book"), (F.col("book") == F.col("_book")) & (F.col("_span.ch") == F.col("_ch")), "left")
    one = F.struct("_ix", F.col("_span.ch").alias("ch"), F.col("_span.vs").alias("vs"), F.coalesce("_span.ve", "last").alias("ve"), "last")
    folded = bound.groupBy("_ref").agg(F.array_sort(F.collect_list(one)).alias("_found"))
    found = F.col("_found")
    outside = F.exists(found, lambda x: (x["vs"] < 1) | (x["ve"] < 1) | (x["vs"] > x["last"]) | (x["ve"] > x["last"]))
    late = (
        F.when(F.exists(found, lambda x: x["last"].isNull()), "chapter out of range")
        .when(yes(outside), "verse out of range")
        .when(yes(F.exists(found, lambda x: x["vs"] > x["ve"])), "inverted")
    )
    done = read.join(folded, "_ref", "left").withColumn("error", F.coalesce("_early", late))
    good = F.col("error").isNull()
    plain = F.transform(found, lambda x: F.struct(x["ch"].alias("ch"), x["vs"].alias("vs"), x["ve"].alias("ve")))
    done = done.select("_ref", "book", "book_order", "error", F.when(good, plain).alias("spans"), F.when(good, display("book", "_found")).alias("display"))
    return df.join(done, F.coalesce(F.col(ref), F.lit("")) == F.col("_ref"), "left").drop("_ref")


def display(book, spans) -> Column:
    """Canonical text of spans (ch, vs, ve, last): whole chapters without verses, ranges with their ends, lists with commas."""
    book, spans = F.col(book), F.col(spans)
    head, tail = F.element_at(spans, 1), F.element_at(spans, -1)
    text = lambda x: x.cast("string")
    whole = lambda s: (s["vs"] == 1) & (s["ve"] == s["last"])
    verses = lambda s: F.when(s["vs"] == s["ve"], text(s["vs"])).otherwise(F.concat(text(s["vs"]), F.lit("-"), text(s["ve"])))
    one = F.when(whole(head), F.concat(book, F.lit(" "), text(head["ch"]))).otherwise(F.concat(book, F.lit(" "), text(head["ch"]), F.lit(":"), verses(head)))
    listed = F.concat(book, F.lit(" "), text(head["ch"]), F.lit(":"), F.array_join(F.transform(spans, verses), ","))
    range_ = F.concat(book, F.lit(" "), text(head["ch"]), F.lit("-"), text(tail["ch"]))
    crossed = F.concat(book, F.lit(" "), text(head["ch"]), F.lit(":"), text(head["vs"]), F.lit("-"), text(tail["ch"]), F.lit(":"), text(tail["ve"]))
    return F.when(F.size(spans) == 1, one).when(head["ch"] == tail["ch"], listed).when(F.forall(spans, whole), range_).otherwise(crossed)


def range_display(book, sc, sv, ec, ev) -> Column:
    """Text of a note's range, where verse 0 stands for the whole chapter."""
    b, sc, sv, ec, ev = (F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in (book, sc, sv, ec, ev))
    return (
        F.when((sv == "0") & (ev == "0"), F.when(sc == ec, F.concat(b, F.lit(" "), sc)).otherwise(F.concat(b, F.lit(" "), sc, F.lit("-"), ec)))
        .when((sc == ec) & (sv == ev), F.concat(b, F.lit(" "), sc, F.lit(":"), sv))
        .when(sc == ec, F.concat(b, F.lit(" "), sc, F.lit(":"), sv, F.lit("-"), ev))
        .otherwise(F.concat(b, F.lit(" "), sc, F.lit(":"), sv, F.lit("-"), ec, F.lit(":"), ev))
    )


def lexicon_number(raw) -> Column:
    """``g3056``, `` G03056 `` and the like as ``G3056``; null if it is no such number."""
    x, pattern = F.upper(F.trim(raw)), "^([GH])0*([0-9]+)$"
    return F.when(x.rlike(pattern), F.concat(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))


# Roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(x, lenient: bool = False) -> Column:
    """Value of a roman numeral, null for other text; ``lenient`` reads j as i, and l after i or v as i."""
    x = F.lower(F.trim(x))
    if lenient:
        x = F.regexp_replace(F.replace(F.regexp_replace(x, r"\.$", ""), F.lit("j"), F.lit("i")), "(?<=[iv])l", "i")
    values = F.create_map(*[F.lit(v) for pair in ROMAN.items() for v in pair])
    digits = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: values[c])
    # from the right, a digit below the largest so far counts against the sum
    folded = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("prev")), lambda a, v: F.struct((a["sum"] + F.when(v < a["prev"], -v).otherwise(v)).alias("sum"), F.when(v < a["prev"], a["prev"]).otherwise(v).alias("prev")), lambda a: a["sum"])
    return F.when(x.rlike("^[ivxlcdm]+$"), folded)


def contextual_refs(df: DataFrame, text: str, names: DataFrame, bounds: DataFrame, book: str = "cur_book", chapter: str = "cur_chapter") -> DataFrame:
    """Explodes ``Book c:v, v-v; c:v; v`` lists whose parts inherit book and chapter from the ones before.

    Adds part_ix, ref_book, ref_chapter, ref_verse, and ``outcome``: ok, invalid, chapter only or unreadable.
    """
    from pyspark.sql import Window

    key = F.monotonically_increasing_id()
    parts = df.withColumn("_key", key).select("*", F.posexplode(F.split(F.col(text), r"[ \t]*;[ \t]*")).alias("part_ix", "_part"))
    parts = parts.withColumn("_part", F.regexp_replace(F.trim("_part"), r"\.+$", "")).where("_part <> ''")
    named = resolve_books(parts.withColumn("_name", F.regexp_extract("_part", r"^([1-3]?[A-Za-z]+)[ \t]+", 1)), "_name", names, "_found")
    rest = F.when(F.col("_found").isNotNull(), F.trim(F.regexp_extract("_part", r"^[1-3]?[A-Za-z]+[ \t]+(.*)$", 1))).otherwise(F.col("_part"))
    named = named.withColumn("_rest", rest).withColumn("_only", F.col("_found").isNotNull() & F.col("_rest").rlike("^[0-9]+$"))
    order = Window.partitionBy("_key").orderBy("part_ix").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("ref_book", F.coalesce(F.last("_found", True).over(order), F.col(book)))
    own = F.when(F.col("_rest").rlike("^[0-9]+ *:"), F.regexp_extract("_rest", "^([0-9]+)", 1).try_cast("long"))
    named = named.withColumn("ref_chapter", F.coalesce(F.last(own, True).over(order), F.col(chapter)).cast("long"))
    verses = F.split(F.regexp_replace("_rest", "^[0-9]+ *:", ""), ",")
    pieces = named.select("*", F.explode_outer(F.filter(F.transform(verses, F.trim), lambda p: p != "")).alias("_piece"))
    low, high = F.regexp_extract("_piece", "^([0-9]+)", 1).try_cast("int"), F.regexp_extract("_piece", "([0-9]+)$", 1).try_cast("int")
    good = F.coalesce(F.col("_piece").rlike("^[0-9]+( *- *[0-9]+)?$"), F.lit(False)) & ~F.col("_only")
    listed = F.when(good, F.sequence(F.least(low, high), F.greatest(low, high)))
    last = bounds.select(F.col("book").alias("_last_book"), F.col("chapter").alias("_last_chapter"), "last")
    out = pieces.select("*", F.explode_outer(listed).alias("ref_verse")).join(last, (F.col("ref_book") == F.col("_last_book")) & (F.col("ref_chapter") == F.col("_last_chapter")), "left")
    fits = F.coalesce((F.col("ref_verse") >= 1) & (F.col("ref_verse") <= F.col("last")), F.lit(False))
    outcome = F.when(F.col("_only"), "chapter only").when(F.col("ref_verse").isNull(), "unreadable").when(fits, "ok").otherwise("invalid")
    return out.withColumn("outcome", outcome).select(*df.columns, "part_ix", "ref_book", "ref_chapter", "ref_verse", "outcome")


def normal_anchors(x, single_chapter: list[str]) -> Column:
    """``B 1:5, 7`` to two references, ``B 20`` of a one-chapter book to ``B 1:20``, dots at the end dropped."""
    x = F.regexp_replace(F.trim(x), r"^(.+?)[ \t]+([0-9]+):([0-9]+),[ \t]*([0-9]+)$", "$1 $2:$3; $1 $2:$4")

    def piece(p):
        p = F.trim(p)
        name = F.regexp_extract(p, r"^(.+?)[ \t]+[0-9]+$", 1)
        one = name.isin(single_chapter) & ~p.contains(":") if single_chapter else F.lit(False)
        p = F.when(one, F.regexp_replace(p, r"^(.+?)[ \t]+([0-9]+)$", "$1 1:$2")).otherwise(p)
        return F.regexp_replace(p, r"\.+$", "")

    return F.array_join(F.transform(F.split(x, ";"), piece), "; ")
