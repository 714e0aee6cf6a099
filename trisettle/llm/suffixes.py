"""Removal of long repeated byte strings, by suffix sorting with hash comparisons.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Suffixes that share that many
bytes share an anchor: the k-gram of smallest hash among those inside the string, which winnowing finds in every
text alone. So suffixes are dealt by anchor, as a bucketed suffix array, and only suffixes at anchors are sorted:

1. Anchors of all texts, each with a hash of its context (all bytes that a string around it can cover).
2. Anchors that occur twice with one context are resolved: all their context repeats.
3. The distinct contexts of an anchor with several are sorted by what follows the anchor: a mergesort whose
   comparisons find the common extension by binary search over polynomial prefix hashes. Neighbours' common
   extensions give every pair's; the extension to the left comes the same way, and pairs that share ``LENGTH``
   bytes are verified byte by byte.
4. Anchors with more than ``SMALL`` contexts are not taken into one task: every string of theirs is counted by its
   hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import row_key, small_batches, written
from trisettle.llm.shingles import BYTES, POWERS, mixed, prefix_hash

LENGTH = 200
GRAM = 50
REACH = LENGTH - GRAM
CONTEXT = REACH + GRAM + REACH
SMALL = 64
#: Bits of the filter for anchors whose contexts are wanted, and the most anchors it is used for; beyond, a join.
FILTER_BITS = 1 << 26
FILTER_ROWS = 8_000_000


def windowed_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every ``size`` values in a row, by running minima within blocks from both sides."""
    n = len(x)
    blocks = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1: n])


class Text:
    """A text's bytes with prefix hashes, its anchors and the strings that each anchor stands for."""

    def __init__(self, text: str | None):
        self.data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        self.at = np.zeros(0, np.int64)
        n = len(self.data)
        if n < LENGTH:
            return
        self.sums = prefix_hash(self.data)
        self.grams = mixed(self.hashes(np.arange(n - GRAM + 1), GRAM))
        # rightmost smallest: the place counts down in the low half
        place = np.arange(len(self.grams), dtype=np.uint64)
        low = windowed_minimum(self.grams & np.uint64(0xFFFFFFFF00000000) | np.uint64(0xFFFFFFFF) - place, REACH + 1)
        chosen = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        self.at = chosen[first]
        # strings that start in low..high have this anchor
        self.low, self.high = first, np.append(first[1:], len(chosen))
        self.left = np.minimum(REACH, self.at)
        self.right = np.minimum(REACH, n - self.at - GRAM)

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * POWERS.down[start]

    def contexts(self) -> np.ndarray:
        ends = self.left * (REACH + 1) + self.right
        return mixed(self.hashes(self.at - self.left, self.left + GRAM + self.right) + ends.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(docs: DataFrame) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Text(text.as_py())
                if len(own.at):
                    parts.append((own.grams[own.at], own.contexts(), np.full(len(own.at), doc, np.int64), own.at))
            grams, contexts, ids, places = map(np.concatenate, zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([signed(grams), signed(contexts), pa.array(ids), pa.array(places.astype(np.int32))], ["anchor", "context", "doc_id", "at"])

    return docs.mapInArrow(batches, "anchor long, context long, doc_id long, at int")


def place_bit(doc: np.ndarray | int, at: np.ndarray) -> np.ndarray:
    return mixed(np.asarray(doc).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)) % np.uint64(FILTER_BITS)


def place_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of (doc_id, at); tasks send words of it, merged before they reach the driver."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            bits = place_bit(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            word, bit = (bits >> np.uint64(5)).astype(np.int32), np.int64(1) << (bits & np.uint64(31)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])

    found = wanted.select("doc_id", "at").mapInArrow(batches, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


CONTEXTS = "anchor long, doc_id long, at int, left int, right int, low int, high int, bytes binary"


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts of the wanted anchors (a few others may come along and do no harm: all that they share is true).

    Left and right are the bytes there are on either side, low and high the starts of the anchor's strings relative
    to it; shorter contexts are filled with zeros.
    """
    few = wanted.count() <= FILTER_ROWS
    shared = docs.sparkSession.sparkContext.broadcast(place_filter(wanted)) if few else None

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[list] = [[] for _ in range(8)]
            places = batch.column(2) if shared is None else [None] * batch.num_rows
            for doc, text, own_places in zip(batch.column(0).to_pylist(), batch.column(1), places, strict=True):
                own = Text(text.as_py())
                if not len(own.at):
                    continue
                if shared is None:
                    keep = np.flatnonzero(np.isin(own.at, own_places.as_py()))
                else:
                    bits = place_bit(np.int64(doc), own.at)
                    keep = np.flatnonzero(shared.value[(bits >> np.uint64(5)).astype(np.int64)] >> (bits & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                for i in keep.tolist():
                    at, left, right = int(own.at[i]), int(own.left[i]), int(own.right[i])
                    body = own.data[at - left: at + GRAM + right].tobytes()
                    row = (int(own.grams[at].view(np.int64)), doc, at, left, right, int(own.low[i]) - at, int(own.high[i]) - at, bytes(REACH - left) + body + bytes(REACH - right))
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["anchor", "doc_id", "at", "left", "right", "low", "high", "bytes"])

    if few:
        return docs.mapInArrow(batches, CONTEXTS)
    listed = wanted.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    return docs.join(listed, "doc_id").select("doc_id", "text", "places").mapInArrow(batches, CONTEXTS)


class Aligned:
    """Contexts side by side: all anchors stand in the same columns, so prefix sums compare without shifting."""

    def __init__(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray):
        up, _ = POWERS.to(CONTEXT + 1)
        self.rows, self.left, self.right = rows, left, right
        self.sums = np.zeros((len(rows), CONTEXT + 1), np.uint64)
        np.cumsum(BYTES[rows] * up[:CONTEXT], axis=1, out=self.sums[:, 1:])

    def extension(self, i: np.ndarray, j: np.ndarray, side: np.ndarray, step: int) -> np.ndarray:
        """Common bytes of rows i and j beside the anchor, by binary search over prefix hashes."""
        origin = REACH + GRAM if step > 0 else REACH
        low, high = np.zeros(len(i), np.int64), np.minimum(side[i], side[j]).astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            to = origin + step * middle
            same = self.sums[i, to] - self.sums[i, origin] == self.sums[j, to] - self.sums[j, origin]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def strings(self, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hashes of the strings of LENGTH bytes that begin ``start`` bytes from the anchor of row i."""
        at = start + REACH
        return mixed((self.sums[i, at + LENGTH] - self.sums[i, at]) * POWERS.down[at])

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether what follows the anchor in row i sorts before row j's; a text's end sorts first."""
        common = self.extension(i, j, self.right, 1)
        at = np.minimum(REACH + GRAM + common, CONTEXT - 1)
        a = np.where(common < self.right[i], self.rows[i, at].astype(np.int64), -1)
        b = np.where(common < self.right[j], self.rows[j, at].astype(np.int64), -1)
        return a < b

    def equal(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether rows i and j hold the same bytes from ``left`` before the anchor to ``right`` after it."""
        out = np.zeros(len(i), bool)
        columns = np.arange(CONTEXT)
        for a in range(0, len(i), 10_000):
            part = slice(a, a + 10_000)
            inside = (columns >= REACH - left[part, None]) & (columns < REACH + GRAM + right[part, None])
            out[part] = ~((self.rows[i[part]] != self.rows[j[part]]) & inside).any(axis=1)
        return out


def merge_sorted(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before) -> np.ndarray:
    """Bottom-up mergesort of each segment at once: an element's place in the merged run is its place in its own run
    plus the elements of the sibling run before it, found by binary search. Stable."""
    within = np.arange(len(order)) - np.repeat(starts, sizes)
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max(initial=0):
        run = within // width
        left = run % 2 == 0
        sibling = np.where(left, run + 1, run - 1) * width
        low = np.minimum(sibling, size)
        base, high = low.copy(), np.minimum(sibling + width, size)
        while (active := low < high).any():
            k = np.flatnonzero(active)
            middle = (low[k] + high[k]) >> 1
            other, own = order[start[k] + middle], order[k]
            # of equal elements those of the left run come first
            ahead = np.where(left[k], before(other, own), ~before(own, other))
            low[k], high[k] = np.where(ahead, middle + 1, low[k]), np.where(ahead, high[k], middle)
        pair = (run // 2) * 2 * width
        place = start + pair + (within - run * width) + (low - base)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def repeats(groups: np.ndarray, at: np.ndarray, rows: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (in its text) of what each row shares with another of its group in LENGTH bytes or more."""
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.diff(groups[order], prepend=groups[order][:1] - 1 if len(order) else 0))
    sizes = np.diff(np.append(starts, len(order)))
    order = merge_sorted(order, starts, sizes, rows.before)
    left_in = np.repeat(starts + sizes, sizes) - np.arange(len(order))  # rows from here to the segment's end
    common = np.zeros(len(order), np.int64)
    k = np.flatnonzero(left_in > 1)
    common[k] = rows.extension(order[k], order[k + 1], rows.right, 1)
    out = []
    right, k, distance = common[k], k, 1
    while len(k):
        i, j = order[k], order[k + distance]
        left = rows.extension(i, j, rows.left, -1)
        hit = np.flatnonzero(left + right >= REACH)
        hit = hit[rows.equal(i[hit], j[hit], left[hit], right[hit])]
        for x in (i[hit], j[hit]):
            out.append((x, at[x] - left[hit], at[x] + GRAM + right[hit]))
        distance += 1
        go = left_in[k] > distance
        k, right = k[go], np.minimum(right[go], common[k[go] + distance - 1])
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


SPANS = "doc_id long, start int, end int"


def shared_spans(found: DataFrame) -> DataFrame:
    """Spans shared within anchors of few contexts; rows of an anchor must be together and in a row."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, CONTEXT)
        column = lambda name: table.column(name).to_numpy().astype(np.int64)
        row, start, end = repeats(column("anchor"), column("at"), Aligned(data, column("left"), column("right")))
        return pa.RecordBatch.from_arrays([pa.array(column("doc_id")[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "start", "end"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in source:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            # up to the last change of anchor the groups are complete
            cuts = np.flatnonzero(np.diff(ids)) + 1
            if held and ids[0] != held[-1].column(0)[-1].as_py() and sum(b.num_rows for b in held) > 4_000:
                yield solve(held)
                held = []
            if len(cuts) and sum(b.num_rows for b in held) + cuts[-1] > 4_000:
                yield solve([*held, batch.slice(0, int(cuts[-1]))])
                held, batch = [], batch.slice(int(cuts[-1]))
            held.append(batch)
        if held:
            yield solve(held)

    return found.mapInArrow(batches, SPANS)


def counted_spans(found: DataFrame) -> DataFrame:
    """Spans shared within anchors of many contexts: each string that has the anchor is counted by its hash."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            data = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, CONTEXT)
            at, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 5, 6))
            size = high - low
            row = np.repeat(np.arange(len(at)), size)
            start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[row]
            value = Aligned(data, at, at).strings(row, start)
            yield pa.RecordBatch.from_arrays([signed(value), pa.array(batch.column(1).to_numpy()[row]), pa.array((at[row] + start).astype(np.int32))], ["string", "doc_id", "start"])

    strings = written(found.mapInArrow(batches, "string long, doc_id long, start int"), "strings").distinct()
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    return strings.join(twice, "string", "left_semi").select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """doc_id and byte spans that repeat; spans of a document may overlap."""
    every = written(anchors(texts), "anchors")
    often = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("first"), F.max("context").alias("last")).filter("n > 1")
    # written first: a join of two exchanges can be split where an anchor is very common, one above an aggregate can't
    often = written(often, "recurring-anchors")
    shared = written(every.join(often.select("anchor", (F.col("first") != F.col("last")).alias("several")), "anchor"), "shared-anchors")
    classes = shared.groupBy("anchor", "context", "several").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("one"))
    classes = written(classes.select("anchor", "context", "several", "n", "one.doc_id", "one.at"), "contexts")
    resolved = shared.join(classes.filter("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    whole = resolved.select("doc_id", (F.col("at") - REACH).alias("start"), (F.col("at") + LENGTH).alias("end"))

    wanted = classes.filter("several").select("anchor", "doc_id", "at")
    found = written(contexts(texts, wanted), "anchor-contexts")
    many = written(found.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("anchor"), "frequent-anchors")
    small = found.join(many, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at")
    spans = shared_spans(small).unionByName(counted_spans(found.join(many, "anchor", "left_semi").select(*found.columns)))
    return whole.unionByName(spans)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document.

    A null or empty text has no bytes, and texts under LENGTH bytes lose none; a repeated row is a copy like any
    other, and both lose all; rows are told apart by key and text, so rows without doc_id and two texts of one are
    judged each; extra columns are ignored; an empty table gives an empty result.
    """
    rows = small_batches(docs).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), row_key(key, text).alias("doc_id"))
    texts = rows.select("doc_id", "text")
    spans = written(repeated_spans(texts).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeated-spans")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                if own.is_valid and len(own.values):
                    start, end = (own.values.field(k).to_numpy().clip(0, len(data)) for k in (0, 1))
                    np.add.at(depth, start, 1)
                    np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, len(data), int(gone.sum()), runs, data[~gone].tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(spans, "doc_id", "left").select("key", "text", "spans").mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
