"""Flags and references that models write in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import bind, strip

# fixed values
YES = ("T", "TRUE", "1", "Y", "YES")
NO = ("F", "FALSE", "0", "N", "NO")


def to_bool(c: Column, bound: bool = False) -> Column:
    """True, False or null from the text of a JSON value; numbers equal to 1 and 0 count as well.

    bound: inside lambdas, where Spark would otherwise strip the text for each use of it.
    """
    text = F.upper(strip(c))
    return bind(text, _bool_of) if bound else _bool_of(text)


def _bool_of(text: Column) -> Column:
    # patterns, as casts of other texts cost an exception each
    yes = text.isin(*YES) | text.rlike(r"^1\.0+$")
    no = text.isin(*NO) | text.rlike(r"^-?0(\.0+)?$")
    return F.when(yes, True).when(no, False)


def theme_ref(ref: Column, names: Column, by_index: Column, bound: bool = False) -> Column:
    """The theme that a name, or a number with an optional T before it, stands for; null if none.

    names: array of theme names. by_index: map from the 1-based number to the name. bound: as in `to_bool`.
    """

    def found(text: Column) -> Column:
        number = F.regexp_extract(text, r"(?i)^t?(\d+)$", 1).try_cast("int")
        return F.when(F.array_contains(names, text) & (text != ""), text).otherwise(F.try_element_at(by_index, number))

    return bind(strip(ref), found) if bound else found(strip(ref))
