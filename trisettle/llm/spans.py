"""Spans of regular expressions as Column expressions: code-point positions without any Python on executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of context kept on the left of a match.
CONTEXT = 24
MATCH = "struct<s:int,e:int,m:string,before:string,after:string>"
SPAN = "struct<s:int,k:int,e:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start, end, match, a little text before and the character after.

    The pieces between matches come from a split by the same pattern, made only where there is a match.
    """

    def placed(found: Column, pieces: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.length(pieces[i])
            end = start + F.length(found[i])
            # an empty piece follows another match: its end is the context
            before = F.when((F.length(pieces[i]) == 0) & (i > 0), F.substring(F.get(found, i - 1), -CONTEXT, CONTEXT)).otherwise(F.substring(pieces[i], -CONTEXT, CONTEXT))
            row = F.struct(start.alias("s"), end.alias("e"), found[i].alias("m"), before.alias("before"), F.substring(pieces[i + 1], 1, 1).alias("after"))
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{MATCH}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    def found_or_none(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.array().cast(f"array<{MATCH}>")).otherwise(let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found_or_none)


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))).cast(f"array<{SPAN}>")


def in_order(*arrays: Column) -> Column:
    """Spans by start, then kind, then end; equal ones once."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column, kinds: Sequence[str]) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first names the gap."""
    names = F.array(*map(F.lit, kinds))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["pos"]
        gap = F.when(fresh, F.concat(F.substr(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.lit("<"), names[x["k"]], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
