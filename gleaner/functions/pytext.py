"""Text functions with the white-space and line rules of Python strings, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: one white-space character as str.isspace sees it
SPACE = r"[\s\x1c-\x1f]"
#: where str.splitlines breaks
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"


#: all of them
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, even where f uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def drop_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", "")


def lines(c: Column) -> Column:
    """The pieces between line breaks; a break at the end adds an empty piece."""
    return F.split(c, LINE_BREAK)


def newlines(c: Column) -> Column:
    """Universal-newline translation."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def length_without_breaks(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("\n"), F.lit("")))


def non_negative(c: Column, default: int = 0) -> Column:
    """A text or number as a non-negative whole number; what isn't one gives the default."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint")))
