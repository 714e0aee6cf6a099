"""Pages of a list by keyset: a cursor is the last row's sort key, and the next page is a predicate on it."""

from __future__ import annotations

import base64
import binascii
import datetime
import decimal
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Rows of a page unless asked otherwise, and at most.
DEFAULT_LIMIT, MOST = 50, 2000


class BadPage(ValueError):
    """A cursor that was never given out, or a limit out of bounds."""


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next_cursor: str | None


def encode(values: Sequence) -> str:
    """A cursor of the values of a sort key; each keeps its type."""

    def one(value):
        for kind, name in ((datetime.datetime, "t"), (datetime.date, "d"), (decimal.Decimal, "n")):
            if isinstance(value, kind):
                return {name: value.isoformat() if name != "n" else str(value)}
        return value

    return base64.urlsafe_b64encode(json.dumps([one(v) for v in values], ensure_ascii=False).encode()).decode("ascii")


def decode(cursor: str, n: int) -> list:
    read = {"t": datetime.datetime.fromisoformat, "d": datetime.date.fromisoformat, "n": decimal.Decimal}
    try:
        values = json.loads(base64.b64decode(cursor.encode("ascii"), altchars=b"-_", validate=True).decode("utf-8"))
        out = [read[next(iter(v))](next(iter(v.values()))) if isinstance(v, dict) else v for v in values]
    except (ValueError, KeyError, TypeError, StopIteration, AttributeError, binascii.Error, decimal.InvalidOperation) as error:
        raise BadPage("the cursor cannot be read") from error
    if len(out) != n or any(isinstance(v, list) for v in out):
        raise BadPage("the cursor is of another list")
    return out


def beyond(keys: Sequence[tuple[str, str]], values: Sequence) -> Column:
    """Rows after ``values`` in the order of ``keys`` ((column, asc or desc), nulls last): comparisons of columns with
    literals, which reach the scan."""
    out = F.lit(False)
    for (name, direction), value in reversed(list(zip(keys, values, strict=True))):
        col = F.col(name)
        if value is None:
            out = col.isNull() & out
        else:
            out = (col > value if direction == "asc" else col < value) | col.isNull() | ((col == value) & out)
    return out


def page(rows: DataFrame, keys: Sequence[tuple[str, str]], limit: int = DEFAULT_LIMIT, cursor: str | None = None) -> Page:
    """The next ``limit`` rows in the order of ``keys``, of which the last must be unique, and the cursor of the page
    after, None on the last. A page is ``MOST`` rows at most."""
    if not 0 < limit <= MOST:
        raise BadPage(f"a page has 1 to {MOST} rows")
    if cursor is not None:
        rows = rows.filter(beyond(keys, decode(cursor, len(keys))))
    order = [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in keys]
    found = rows.orderBy(*order).limit(limit + 1).collect()
    items = found[:limit]
    return Page(items, encode([items[-1][c] for c, _ in keys]) if len(found) > limit else None)
