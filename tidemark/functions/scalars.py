"""Column expressions shared by operators and plans.  All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Check outcomes from best to worst.
STATUS_ORDER = ("ok", "violation", "lagging", "source_unavailable", "error")
#: Order states; ``cancelled`` stands apart from the ladder.
LADDER = ("created", "paid", "shipped", "delivered")
#: What an age reads where nothing has happened yet.
NEVER = 99999


def status_rank(status: Column) -> Column:
    """Position in ``STATUS_ORDER``; sorting by the name would be wrong."""
    return F.array_position(F.array(*map(F.lit, STATUS_ORDER)), status).cast("int")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def months_between_firsts(earlier: Column, later: Column) -> Column:
    """Calendar months crossed."""
    return (month_index(later) - month_index(earlier)).cast("int")


def day_key(t: Column) -> Column:
    """A day as the number yyyymmdd."""
    return (F.year(t) * 10_000 + F.month(t) * 100 + F.dayofmonth(t)).cast("int")


def hours_crossed(earlier: Column, later: Column) -> Column:
    """Full clock hours crossed (00:59 to 01:01 is 1)."""
    return F.floor(F.unix_seconds(later) / 3600).cast("long") - F.floor(F.unix_seconds(earlier) / 3600).cast("long")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A rounded percentage, null for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def sum_if(cond: Column, x: Column) -> Column:
    """The sum of ``x`` where ``cond`` holds, 0 where it never does."""
    return F.sum(F.when(cond, x).otherwise(F.lit(0)))


def money(x: Column, precision: int = 38) -> Column:
    return x.cast(f"decimal({precision},2)")


def cents(x: Column) -> Column:
    return (x * 100).cast("bigint")


def canonical(*cols: Column) -> Column:
    """One text for a row: nulls empty, fields apart by U+001F."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def fingerprint(text: Column) -> Column:
    """The first 64 bits of the MD5 as a signed number."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint")


def readable_size(n: int) -> str:
    """Bytes in binary units with two decimals."""
    size = float(n)
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            return f"{size:.2f} {unit}"
        size /= 1024
    raise AssertionError
