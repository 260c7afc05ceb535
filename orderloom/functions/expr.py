"""Pure column expressions: calendar, keyed draws, text rules, lazy assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bookkeeping codes that are not merchandise (case-sensitive) and the voucher prefix.
NON_PRODUCT_CODES = (
    "POST", "DOT", "C2", "D", "M", "m", "S", "B", "BANK CHARGES", "AMAZONFEE",
    "ADJUST", "ADJUST2", "CRUK", "TEST001", "TEST002", "PADS",
)
VOUCHER_PREFIX = "gift_"

# Description words that decide the size class, large words first.
LARGE_WORDS = (
    "JUMBO", "GIANT", "LARGE", "BIG", "CABINET", "CHEST", "DRAWER",
    "DOORMAT", "PARASOL", "STOOL", "CAKESTAND", "HAMPER",
)
SMALL_WORDS = (
    "MINI", "SMALL", "TINY", "CHARM", "KEYRING", "KEY RING", "PENCIL",
    "CARD", "BADGE", "MAGNET", "BUTTON", "EGG", "TRINKET",
)


def week_end(ts: Column) -> Column:
    """Sunday closing the Monday-to-Sunday week of ``ts``."""
    day = F.to_date(ts)
    return F.date_add(day, 6 - F.weekday(day))


def keyed_uniform(seed: int, salt: str, key: Column) -> Column:
    """A stable draw in [0, 1) that depends on seed, salt and key only, never on row order."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def is_non_product(code: Column) -> Column:
    listed = code.isin(*NON_PRODUCT_CODES)
    return F.coalesce(listed | F.lower(code).startswith(VOUCHER_PREFIX), F.lit(False))


def is_cancelled(invoice: Column) -> Column:
    return F.coalesce(invoice.startswith("C"), F.lit(False))


def size_class(description: Column) -> Column:
    text = F.upper(F.coalesce(description, F.lit("")))
    return (
        F.when(text.rlike("|".join(LARGE_WORDS)), "large")
        .when(text.rlike("|".join(SMALL_WORDS)), "small")
        .otherwise("medium")
    )


def required(value: Column, dtype: str, message: Column | str) -> Column:
    """``value`` cast to ``dtype``; a NULL fails the job when the row is evaluated."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(value.cast(dtype), F.raise_error(text).cast(dtype))


def money(value: Column) -> Column:
    """Money as an exact decimal, so sums do not depend on the order of the rows."""
    return value.cast("decimal(18,4)")


def require(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """``df`` unchanged; a row on which ``holds`` is not true fails the job, whatever columns are read later.

    A guard inside a column goes when the column is not read; a filter stays.
    """
    return df.filter(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
