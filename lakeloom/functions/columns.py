"""Column functions: conversions that never fail, and small predicates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def to_boolean(name: str) -> Column:
    """true/1 and false/0 in any case; all else, padded text included, is null."""
    low = F.lower(F.col(name))
    return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))


def convert(name: str, kind: str) -> Column:
    """The typed value of a text column, null where the text can't be read; trims spaces only."""
    c = F.col(name)
    return {
        "long": lambda: c.try_cast("bigint"),
        "int": lambda: c.try_cast("int"),
        "money": lambda: c.try_cast(MONEY),
        "text": lambda: F.trim(c),
        "lower": lambda: F.lower(F.trim(c)),
        "date": lambda: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"),
        "timestamp": lambda: F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")),
        "boolean": lambda: to_boolean(name),
    }[kind]()


def live(name: str = "is_deleted") -> Column:
    """Not soft-deleted; a null flag counts as live."""
    return ~F.coalesce(F.col(name), F.lit(False))


def date_key(c: Column) -> Column:
    """yyyyMMdd as a number, by arithmetic rather than by formatting and parsing a text."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def differs(a: Column, b: Column, tolerance: str = "0.01") -> Column:
    """Whether two amounts are more than the tolerance apart."""
    return F.abs(a - b) > F.lit(Decimal(tolerance))


def csv_text(c: Column, kind: str) -> Column:
    """A value as the CSV export writes it; null becomes empty. Fractions of seconds are written where there are any."""
    whole, parts = F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.date_format(c, "SSSSSS")
    text = {
        "timestamp": lambda: F.when(parts == "000000", whole).otherwise(F.concat(whole, F.lit("."), parts)),
        "date": lambda: F.date_format(c, "yyyy-MM-dd"),
        "boolean": lambda: F.when(c, "true").when(~c, "false"),
    }.get(kind, lambda: c.cast("string"))()
    return F.coalesce(text, F.lit(""))
