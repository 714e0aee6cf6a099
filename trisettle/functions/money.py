"""Money as integer paise: parsing, printing and the rounding rules that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def to_paise(text: Column) -> Column:
    """Rupee text to paise, half up to two places; null where it is no amount or a bare integer without a unit.

    Takes a currency mark (rupee sign, INR, Rs), Indian grouping commas, a leading ``(-)`` or minus, and parentheses
    around the whole as a negative.
    """
    bare = F.trim(F.regexp_replace(text, r"(?i)₹|INR|Rs\.?", ""))
    negative = bare.rlike(r"^\(-\)|^-|^\([^-].*\)$")
    number = F.regexp_replace(F.regexp_replace(bare, r"^\(-\)|^-", ""), r"[,\s()]", "")
    value = F.when(number.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.round(number.try_cast("decimal(30,6)"), 2) * 100).cast("bigint")
    return F.when(negative, -value).otherwise(value)


def fmt_inr(paise: Column) -> Column:
    """Paise as rupees with Indian grouping: the last three digits, then pairs."""
    size = F.abs(paise)
    whole = ((size - size % 100) / 100).cast("bigint").cast("string")
    pairs = F.reverse(F.regexp_replace(F.reverse(F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))), "([0-9]{2})(?=[0-9])", "$1,"))
    grouped = F.when(F.length(whole) > 3, F.concat(pairs, F.lit(","), F.substring(whole, -3, 3))).otherwise(whole)
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def half_up(value: Column, places: int = 0) -> Column:
    return F.round(value, places)


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def per_line(rate_percent: Column | str, basis: Column) -> Column:
    """A deduction line: a percentage of a basis, rounded half up to whole paise by itself."""
    rate = F.lit(rate_percent).cast("decimal(20,6)") if isinstance(rate_percent, str) else rate_percent
    return F.round(basis.cast("decimal(20,0)") * rate / F.lit(100).cast("decimal(3,0)"), 0).cast("bigint")
