"""Column functions on dates, digits, hashes and arrays."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# A character of a scanned number, and the characters that it may stand for.
CONFUSED = {
    "0": "Oo9",
    "O": "0",
    "o": "0",
    "9": "08",
    "1": "lIi7",
    "l": "1",
    "I": "1",
    "i": "1",
    "2": "35Ss$#?",
    "7": "1",
    "Z": "1",
    "3": "258SsB",
    "5": "2368Ss",
    "6": "b5",
    "b": "6",
    "8": "359SsB",
    "B": "83",
    "S": "2358",
    "s": "2358",
    "$": "25",
    "#": "2",
    "4": "^",
    "^": "42",
    "?": "2",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_date(x) -> Column:
    """A date of the form YYYY-MM-DD, else null."""
    x = _c(x)
    return F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def plan_day(start, today, days: int) -> tuple[Column, Column]:
    """Day of a plan, from 1, and whether it has not begun, is active or is finished."""
    day = F.datediff(_c(today), _c(start)) + 1
    return day, F.when(day < 1, "not begun").when(day > days, "finished").otherwise("active")


def utc_stamp(at=None) -> Column:
    """A time, or else the clock's, in UTC to the second, as ISO text."""
    if at is None:
        at = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(_c(at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def is_leap(x) -> Column:
    year = F.year(_c(x))
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def leap_day_of_year(x) -> Column:
    """1 to 366 as if each year were a leap year, so that the first of March is always day 61."""
    x = _c(x)
    return F.dayofyear(x) + F.when(~is_leap(x) & (F.month(x) > 2), 1).otherwise(0)


def month_day_number(month, day) -> Column:
    return F.dayofyear(F.make_date(F.lit(2024), _c(month), _c(day)))


MONTHS = "january february march april may june july august september october november december".split()


def month_name_key(x) -> Column:
    """``january-1`` as a leap day number, null for no such date."""
    name, day = F.lower(F.regexp_extract(_c(x), "^([A-Za-z]+)-[0-9]+$", 1)), F.regexp_extract(_c(x), "^[A-Za-z]+-([0-9]+)$", 1)
    month = F.array_position(F.lit(MONTHS), name).cast("int")
    return F.when(month > 0, F.dayofyear(F.try_to_date(F.concat_ws("-", F.lit("2024"), month.cast("string"), day), "yyyy-M-d")))


def hash_modulo(text, n) -> Column:
    """SHA-256 of a text modulo n, folded digit by digit, since it exceeds every integer type."""
    digits = F.transform(F.filter(F.split(F.sha2(_c(text), 256), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * 16 + x) % _c(n))


def even_sizes(total, parts: int) -> Column:
    """Sizes of an even split, the larger ones first."""
    total = _c(total)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.floor(total / parts) + F.when(i < total % parts, 1).otherwise(0))


def digit_differences(a, b) -> Column:
    """Places in which two strings of one length differ, null for others."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def lost_a_digit(token, expected) -> Column:
    """The token is the expected number without its first or its last digit."""
    token, e = _c(token), _c(expected).cast("string")
    n = F.length(e)
    return (F.length(token) == n - 1) & ((token == F.substring(e, F.lit(2), n)) | (token == F.substring(e, F.lit(1), n - 1)))


def confusion_substitutions(token, expected, most: int = 2) -> Column:
    """How many characters must be read as the digit that they are taken for; null if that doesn't give the expected number."""
    token, e = _c(token), _c(expected)
    may = F.create_map(*[F.lit(v) for pair in CONFUSED.items() for v in pair])
    cost = F.zip_with(F.split(token, ""), F.split(e, ""), lambda x, y: F.when(x == y, 0).when(F.coalesce(may[x] == y, F.lit(False)), 1).otherwise(100))
    total = F.aggregate(cost, F.lit(0), lambda s, x: s + x)
    return F.when((F.length(token) == F.length(e)) & (F.length(token) > 0) & (total <= most), total)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, 0 to 1, as the standard library's sequence matcher has it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def longest_prefix(words, within) -> Column:
    """How many first words of one array stand in a row somewhere in another."""
    words, within = _c(words), _c(within)

    def found(k):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(within) - k + 1))
        return F.exists(starts, lambda i: F.slice(within, i, k) == F.slice(words, 1, k))

    sizes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)))
    fits = F.filter(sizes, lambda k: (k <= F.size(words)) & (k <= F.size(within)) & found(k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def ordered_match(words, within, start=0) -> Column:
    """Words found in order in another array: struct of pos (after the last one found) and matched; absent words are passed over."""
    words, within = _c(words), _c(within)
    first = F.struct(F.lit(start).cast("int").alias("pos"), F.lit(0).alias("matched"))

    def step(a, w):
        rest = F.slice(within, a["pos"] + 1, F.greatest(F.lit(0), F.size(within) - a["pos"]))
        at = F.array_position(rest, w).cast("int")
        return F.when(at > 0, F.struct((a["pos"] + at).alias("pos"), (a["matched"] + 1).alias("matched"))).otherwise(a)

    return F.aggregate(words, first, step)


def match_strength(words, within, start=0) -> Column:
    """strong: all words in order; weak: two or more and at least half; none."""
    m, n = ordered_match(words, within, start)["matched"], F.size(_c(words))
    return F.when((n >= 1) & (m == n), "strong").when((m >= 2) & (m * 2 >= n), "weak").otherwise("none")
