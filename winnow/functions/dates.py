"""Date parsing over a fixed list of formats, and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import c, is_date, is_text, strip

# Shape test and parse pattern; month-first wins where both readings are possible.
# The shape test keeps the parser from raising and catching an error per row and format.
FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
)


def parse_date(x: Column) -> Column:
    """Text to timestamp, NULL where no listed format fits."""
    t = strip(x)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt))) for shape, fmt in FORMATS])


def as_date(df: DataFrame, name: str) -> Column:
    """Any column as timestamp: dates as they are, text through the format list, else NULL."""
    if is_date(df, name):
        return c(name).cast("timestamp")
    if is_text(df, name):
        return parse_date(c(name))
    return F.lit(None).cast("timestamp")


def strftime_to_java(fmt: str) -> str:
    """Translate the handful of strftime directives used as target formats."""
    table = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy",
             "%b": "MMM", "%B": "MMMM"}
    for k, v in table.items():
        fmt = fmt.replace(k, v)
    if "%" in fmt:
        raise ValueError(f"unsupported directive in {fmt!r}")
    return fmt


def date_parts(ts: Column, prefix: str, basic: bool = False) -> dict[str, Column]:
    """Calendar features; Monday is day 0."""
    dow = F.weekday(ts)
    parts = {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts),
        "dayofweek": dow, "quarter": F.quarter(ts),
    }
    if not basic:
        parts["week_of_year"] = F.weekofyear(ts).cast("double")
    parts["is_weekend"] = F.coalesce((dow >= 5).cast("int"), F.lit(0))
    if not basic:
        parts["is_month_start"] = F.coalesce((F.dayofmonth(ts) == 1).cast("int"), F.lit(0))
        parts["is_month_end"] = F.coalesce((F.to_date(ts) == F.last_day(ts)).cast("int"), F.lit(0))
    return {f"{prefix}_{k}": v for k, v in parts.items()}
