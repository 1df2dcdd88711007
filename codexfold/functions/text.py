"""Column expressions that give the same text results as Python's ``str``.

Everything here is a native Spark expression; lengths and slices count code
points on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim by character set: linear, and no regular expression to backtrack."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def head(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def suffix(path: Column) -> Column:
    """Lower-cased last suffix as pathlib sees it ('' when there is none)."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def lossy_utf8(content: Column) -> Column:
    """UTF-8 decode with malformed bytes as U+FFFD (``decode`` would raise)."""
    return F.make_valid_utf8(content.cast("string"))


def nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Constant dictionary as a map literal: no join for a handful of fixed rows."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)
