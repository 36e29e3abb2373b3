"""Text expressions: casing, whitespace, character classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .core import strip


def title_case(x: Column) -> Column:
    """Capitalise after every non-letter ("o'neil" -> "O'Neil"); `initcap` splits on blanks only."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def collapse_spaces(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def remove_special(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\w\s]", "")


def remove_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\d+", "")


def ascii_fold(x: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII (no built-in does this).

    The function is local, so that it travels to the executors by value."""
    def fold(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda v: None if v is None else
                     unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))

    return F.pandas_udf(fold, StringType())(x)


TEXT_OPS = {
    "strip": strip,
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "remove_special": remove_special,
    "remove_numbers": remove_digits,
    "remove_extra_spaces": collapse_spaces,
    "normalize_unicode": ascii_fold,
}


def apply_case(x: Column, case: str) -> Column:
    if case not in ("upper", "lower", "title"):
        raise ValueError(f"case must be upper, lower or title, not {case!r}")
    return TEXT_OPS[case](x)


def is_upper(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def is_lower(x: Column) -> Column:
    return (x == F.lower(x)) & (x != F.upper(x))


def is_title(x: Column) -> Column:
    return (x == title_case(x)) & (F.upper(x) != F.lower(x))


def word_count(x: Column) -> Column:
    t = strip(x)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+")))
