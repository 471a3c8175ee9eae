"""Column -> Column functions; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

#: The date formats tried in this order, and what the currency suffixes stand for.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d MMM yyyy")
SUFFIXES = {"M": 1e6, "K": 1e3}


def round_like(x: Column, digits: int) -> Column:
    """Round a double half away from zero after scaling it, as most SQL engines do (Spark rounds its decimal form instead)."""
    scale = float(10**digits)
    return F.round(x * F.lit(scale)) / F.lit(scale)


def exact_sum(x: Column) -> Column:
    """The sum of a double with at most six decimals, added up exactly: it doesn't depend on the order of rows or on how they are partitioned."""
    return F.sum(x.cast("decimal(20,6)")).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def strip(x: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def title(x: Column) -> Column:
    """Each run of letters with its first in upper case and the rest in lower case, also after apostrophes and hyphens."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def is_date(kind: DataType) -> bool:
    return isinstance(kind, (DateType, TimestampType, TimestampNTZType))


def currency(x: Column) -> Column:
    """A euro amount such as 1.5M or 20K as a double; null where it is none."""
    pattern = r"(?i)^€?\s*([0-9.]+)\s*([MK]?)$"
    raw = strip(x.cast("string"))
    number = F.regexp_extract(raw, pattern, 1).try_cast("double")
    suffix = F.upper(F.regexp_extract(raw, pattern, 2))
    scale = F.lit(1.0)
    for letter, factor in SUFFIXES.items():
        scale = F.when(suffix == letter, F.lit(factor)).otherwise(scale)
    return number * scale


def rating(x: Column) -> Column:
    """A rating with an optional modifier, such as 85+2, as their sum; null where it is none."""
    pattern = r"^([0-9]+)\s*([+-]\s*[0-9]+)?$"
    raw = strip(x.cast("string"))
    base = F.regexp_extract(raw, pattern, 1).try_cast("int")
    modifier = F.regexp_replace(F.regexp_extract(raw, pattern, 2), r"\s+", "")
    return base + F.coalesce(modifier.try_cast("int"), F.lit(0))


def parsed_dates(x: Column) -> list[Column]:
    """The date under each format; null where it doesn't fit."""
    return [F.to_date(F.try_to_timestamp(strip(x), F.lit(f))) for f in DATE_FORMATS]


def date_key(d: Column) -> Column:
    """yyyymmdd as an int."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def days_between(start: Column, end: Column) -> Column:
    """Day boundaries from start to end."""
    return F.datediff(end, start).cast("bigint")


def fiscal_quarter(d: Column, first_month: int) -> Column:
    """1 to 4, in a fiscal year that begins in that month."""
    return F.quarter(F.add_months(d, 1 - first_month)).cast("bigint")
