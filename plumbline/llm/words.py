"""The word list of a sentence and the name set of a column list, as Spark expressions.

A word is a run of letters, digits and underscores. Comparison signs, minus signs of numbers and decimal points between digits are
content; other punctuation, blanks, invisible characters and letter case are formatting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII members come first: that part of a class is one table look-up. Letters are lower case by then.
_RUN = r"[0-9a-z_\p{L}\p{M}\p{N}]"
#: A minus sign stands before a digit and after no word; a point between digits stays inside its number; signs of comparison are single.
TOKEN = rf"(?:-(?=\p{{N}})(?<!{_RUN}-))?{_RUN}++(?:\.(?<=\p{{N}}\.)(?=\p{{N}}){_RUN}++)*+|[<>=]|!(?==)"
#: Formatting characters that have no width: they part no word.
_INVISIBLE = "\\u00AD\\u200B-\\u200F\\u2028-\\u202E\\u2060-\\u2064\\uFEFF\\u180E"
_SIGNS = {"−﹣－": "-", "＜": "<", "＞": ">", "＝": "=", "≤": "<=", "≥": ">=", "≠": "!="}
_NAME = rf"{_RUN}++(?:[.$-]{_RUN}++)*+"


def plain(c: Column) -> Column:
    """Lower case (through upper case, so that final forms and sharp s fall together), one form of each sign, no invisible characters."""
    tidy = F.regexp_replace(c, f"[{_INVISIBLE}]+", "")
    for k, v in _SIGNS.items():
        tidy = F.regexp_replace(tidy, f"[{k}]", v)
    return F.lower(F.upper(F.when(c.rlike(f"[{_INVISIBLE}{''.join(_SIGNS)}]"), tidy).otherwise(c)))


def words(c: Column) -> Column:
    """The word list; null for null."""
    return F.regexp_extract_all(plain(c), F.lit(TOKEN), F.lit(0))


def names(c: Column) -> Column:
    """The set of names in a column list; the empty set for null and blank."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(plain(c), F.lit(_NAME), F.lit(0))), F.array().cast("array<string>"))


def is_blank(c: Column) -> Column:
    """Null, or nothing but blanks and invisible characters."""
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\p{C}]")
