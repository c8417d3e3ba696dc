"""Scalar rules for catalogue documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalogue format.
WORK_PREFIX = "/works/"
MAX_JOINED = 5
PRICE_FLOOR = 5
PRICE_STEPS = 4501


def first_or_default(items: Column, default: str = "") -> Column:
    """First element as text; ``default`` for a missing or empty list."""
    return F.coalesce(F.get(items, F.lit(0)).cast("string"), F.lit(default))


def joined_head(items: Column, max_chars: int) -> Column:
    """Up to five elements joined by ``", "``, cut to ``max_chars`` characters.

    A null element prints as ``None``; a null or empty list gives ``""``.
    """
    text = F.array_join(F.slice(items, 1, MAX_JOINED), ", ", "None")
    return F.coalesce(F.substring(text, 1, max_chars), F.lit(""))


def work_key(key: Column) -> Column:
    return F.replace(key, F.lit(WORK_PREFIX), F.lit(""))


def steady_price(key: Column) -> Column:
    """A made-up price in [5, 50] that is the same each time a key is seen."""
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % PRICE_STEPS
    return (F.lit(PRICE_FLOOR) + draw / F.lit(100)).cast("decimal(10,2)")
