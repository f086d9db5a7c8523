"""Text expressions. Whitespace and word classes are the Unicode ones; Java's own are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the regex classes that equal Python's Unicode \s, \S and \w
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_WS = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_KEPT = r"[^\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}.,!?'\"]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop leading and trailing whitespace of any kind."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def is_blank(c: Column | str) -> Column:
    """True when nothing but whitespace is left."""
    return ~_col(c).rlike(NOT_WS)


def words(c: Column | str) -> Column:
    """Lower-cased words, cut at whitespace runs, none empty."""
    parts = F.split(F.lower(_col(c)), f"{WS}+")
    return F.filter(parts, lambda w: w != "")


def normal_title(c: Column | str) -> Column:
    """Title as compared by the title rule: stripped, lower case, NULL as ''."""
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def clean_text(c: Column | str) -> Column:
    """Strip markup, links, symbols and doubled punctuation; NULL becomes ''."""
    out = F.coalesce(_col(c).cast("string"), F.lit(""))
    for pattern, into in (
        (r"<[^>]+>", ""),
        (rf"http[s]?://{NOT_WS}+", ""),
        (NOT_KEPT, " "),
        (r"[\"']{2,}", '"'),
        (rf"{WS}+([.!?])", "$1"),
        (rf"{WS}+", " "),
    ):
        out = F.regexp_replace(out, pattern, into)
    return strip(out)


def shorten(c: Column | str, limit: int = 20) -> Column:
    """Labels longer than ``limit`` characters keep that many and get '...'."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def preview(c: Column | str, limit: int = 150) -> Column:
    """First ``limit`` characters followed by '...', whatever the length."""
    return F.concat(F.substring(_col(c), 1, limit), F.lit("..."))
