"""Column helpers shared by all operators: quoting, type groups, missing values, coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that count as missing (compared trimmed and lower-cased).
MISSING_SENTINELS = (
    "", "null", "na", "n/a", "none", "nan", "nil", "missing", "-", "--",
    "n.a.", "n.a", "#n/a", "#na", "#null",
)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DATE = (T.DateType, T.TimestampType, T.TimestampNTZType)


def c(name: str) -> Column:
    """Column reference that is safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"no such column: {', '.join(gone)}")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), _NUMERIC)


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), _INTEGRAL)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def is_date(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), _DATE)


def is_bool(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.BooleanType)


def numeric_cols(df: DataFrame) -> list[str]:
    return [n for n in df.columns if is_numeric(df, n)]


def text_cols(df: DataFrame) -> list[str]:
    return [n for n in df.columns if is_text(df, n)]


def date_cols(df: DataFrame) -> list[str]:
    return [n for n in df.columns if is_date(df, n)]


def flat_cols(df: DataFrame) -> list[str]:
    """Columns the reports cover: nested ones pass through untouched."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [n for n in df.columns if not isinstance(dtype(df, n), nested)]


def strip(x: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` drops blanks only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def parse_number(x: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    t = F.trim(x)
    d = t.try_cast("double")
    return F.when(~F.isnan(d) & ~t.rlike("(?i)[0-9.][df]$"), d)


def num(df: DataFrame, name: str) -> Column:
    """The column as a double, with NaN and unparsable text as NULL."""
    if is_text(df, name):
        return parse_number(c(name))
    if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)):
        d = c(name).cast("double")
        return F.when(~F.isnan(d), d)
    if is_numeric(df, name):
        return c(name).cast("double")
    if is_bool(df, name):
        return c(name).cast("int").cast("double")
    return F.lit(None).cast("double")


def sentinel(x: Column) -> Column:
    return F.lower(strip(x)).isin(*MISSING_SENTINELS)


def is_missing(df: DataFrame, name: str, sentinels: bool = True) -> Column:
    """True where the cell is NULL, NaN or (for text) one of the sentinel strings."""
    x = c(name)
    m = x.isNull()
    if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)):
        m = m | F.isnan(x)
    if sentinels and is_text(df, name):
        m = m | sentinel(x)
    return F.coalesce(m, F.lit(True))


def present(df: DataFrame, name: str, sentinels: bool = True) -> Column:
    """The cell, or NULL where it is missing."""
    return F.when(~is_missing(df, name, sentinels), c(name))


def fold_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column."""
    fl = [n for n in df.columns if isinstance(dtype(df, n), (T.FloatType, T.DoubleType))]
    if not fl:
        return df
    return df.withColumns({n: F.when(~F.isnan(c(n)), c(n)) for n in fl})


def count_if(x: Column) -> Column:
    return F.count(F.when(x, F.lit(1)))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage of ``whole``, 0 when there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def words(name: str) -> list[str]:
    """Name split into lower-case word tokens: ``userAge_total`` -> user, age, total."""
    import re

    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]


def name_has(name: str, vocabulary, suffix_from: int = 4) -> bool:
    """Whether a column name mentions one of the words.

    A word matches a whole token ("width" is no "id"), its plural, or the end of a compound
    token when it has at least ``suffix_from`` letters ("totalprice" is a price)."""
    toks = words(name)
    joined = "_".join(toks)
    for w in vocabulary:
        if "_" in w:
            if w in joined:
                return True
        elif any(t == w or t == w + "s" or (len(w) >= suffix_from and t.endswith(w)) for t in toks):
            return True
    return False


# Column-name vocabularies of the name-driven checks.
POSITIVE_WORDS = ("age", "price", "salary", "cost", "revenue", "count", "quantity", "qty")
POSITIVE_WORDS_WIDE = POSITIVE_WORDS + ("height", "weight")
PERCENT_WORDS = ("percent", "pct", "rate", "probability")
PERCENT_WORDS_WIDE = PERCENT_WORDS + ("share",)
ID_WORDS = ("id", "uuid", "key", "identifier", "code", "account_no", "user_id")
DATE_WORDS = ("date", "time", "dob", "created", "timestamp")
DATE_WORDS_WIDE = DATE_WORDS + ("year",)
QUALITY_DATE_WORDS = ("date", "time", "timestamp", "year")
FUTURE_OK_WORDS = ("due", "expiry", "target", "future")
BUSINESS_WORDS = ("work", "trade", "invoice", "payroll", "business")
EMAIL_WORDS = ("email",)
PHONE_WORDS = ("phone", "tel", "mobile")
