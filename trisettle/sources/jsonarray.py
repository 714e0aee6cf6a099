"""A large JSON array of objects, read by byte ranges in many tasks.

Where a range begins nothing says whether its first byte is inside a string or how deep it is. A first pass counts for
every range its quotes and, for both beginnings, how much deeper it ends; running sums over the ranges of a file then
give every range its true beginning. The second pass yields the objects that begin in a range, reading on past its end
for the last one. Only ranges and their counts are ever in one place, no file is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 64 << 20
#: Bytes read at once past the end of a range.
AHEAD = 1 << 16
QUOTE, BACKSLASH = ord('"'), ord("\\")


def _opened(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def real_quotes(data: np.ndarray, before: bytes) -> np.ndarray:
    """Places of quotes that no backslash escapes; ``before``: the bytes in front, at least back to a byte that is none."""
    both = np.concatenate([np.frombuffer(before, np.uint8), data])
    at = np.arange(len(both))
    last_other = np.maximum.accumulate(np.where(both != BACKSLASH, at, -1))
    run = at - np.concatenate([[-1], last_other[:-1]]) - 1  # backslashes right in front of each byte
    places = np.flatnonzero((both == QUOTE) & (run % 2 == 0)) - len(before)
    return places[places >= 0]


def structure(data: np.ndarray, before: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, steps) of brackets outside strings: +1 opens, -1 closes."""
    quotes = real_quotes(data, before)
    opens, closes = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
    places = np.flatnonzero(opens | closes)
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    return places, np.where(opens[places], 1, -1)


def _before(file, start: int) -> bytes:
    """The bytes in front of ``start``, back to one that is no backslash."""
    width = 16
    while True:
        low = max(0, start - width)
        file.seek(low)
        found = file.read(start - low)
        if low == 0 or found.strip(b"\\"):
            return found
        width *= 4


def ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long")))
    return files.select("path", "bytes", starts.alias("start"))


def begun(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """path, start, inside and depth: how every range of every file begins."""

    def measure(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            rows = []
            for row in batch.itertuples():
                with _opened(row.path) as file:
                    before = _before(file, row.start)
                    file.seek(row.start)
                    data = np.frombuffer(file.read(size), np.uint8)
                rows.append((row.path, row.start, len(real_quotes(data, before)), *[int(structure(data, before, inside)[1].sum()) for inside in (False, True)]))
            yield pd.DataFrame(rows, columns=["path", "start", "quotes", "deeper_out", "deeper_in"])

    parts = ranges(spark, path, size)
    counts = parts.repartition(F.col("path"), F.col("start")).mapInPandas(measure, "path string, start long, quotes long, deeper_out long, deeper_in long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    return known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("deeper_in")).otherwise(F.col("deeper_out"))).over(earlier), F.lit(0))).select("path", "start", "inside", "depth")


def objects(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """path, at (byte where it begins) and record, the text of every object of the arrays in ``path``."""

    def cut(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            for row in batch.itertuples():
                with _opened(row.path) as file:
                    before = _before(file, row.start)
                    file.seek(row.start)
                    text = file.read(size)
                    own = len(text)
                    while True:
                        data = np.frombuffer(text, np.uint8)
                        places, steps = structure(data, before, row.inside)
                        depth = row.depth + np.cumsum(steps)
                        first = places[(steps == 1) & (depth == 2) & (data[places] == ord("{")) & (places < own)]
                        last = places[(steps == -1) & (depth == 1)]
                        ends = np.searchsorted(last, first)
                        more = file.read(max(AHEAD, len(text) - own)) if len(first) and ends[-1] == len(last) else b""
                        if not more:
                            break
                        text += more
                whole = ends < len(last)
                cuts = [(int(a), int(last[e]) + 1) for a, e in zip(first[whole], ends[whole], strict=True)] + [(int(a), len(text)) for a in first[~whole]]
                for low in range(0, len(cuts), 1_000):
                    part = cuts[low:low + 1_000]
                    yield pd.DataFrame({"path": row.path, "at": [row.start + a for a, _ in part], "record": [text[a:b].decode("utf-8", "replace") for a, b in part]})

    rows = begun(spark, path, size)
    return rows.repartition(F.col("path"), F.col("start")).mapInPandas(cut, "path string, at long, record string")


def typed(rows: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of ``objects``: rejects keep the record with reasons (unreadable, unknown key, wrong type,
    missing key). Nothing is dropped."""
    known = [f.name for f in schema.fields]
    raw = F.from_json("record", "map<string,string>")
    parsed = rows.withColumn("raw", raw).withColumn("row", F.from_json("record", schema))
    unreadable = F.col("raw").isNull()
    unknown = F.transform(F.array_except(F.map_keys("raw"), F.array(*map(F.lit, known))), lambda k: F.concat(F.lit("unknown key "), k))
    wrong = F.array_compact(F.array(*[F.when(F.col("raw")[name].isNotNull() & F.col("row")[name].isNull(), F.lit(f"wrong type of {name}")) for name in known]))
    missing = F.array_compact(F.array(*[F.when(F.col("raw")[name].isNull(), F.lit(f"missing {name}")) for name in required] or [F.lit(None).cast("string")]))
    reasons = F.when(unreadable, F.array(F.lit("unreadable"))).otherwise(F.concat(unknown, wrong, missing))
    marked = parsed.withColumn("reasons", reasons)
    return marked.filter(F.size("reasons") == 0).select("path", "at", "row.*"), marked.filter(F.size("reasons") > 0).select("path", "at", "record", "reasons")
