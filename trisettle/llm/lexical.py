"""Ranked lexical search by branch and bound over trees of document ranges.

Documents stand in blocks, each with an index of flat arrays: for every term the documents that hold it and their gains
(the part of a score that does not depend on the term's weight), and above them, level by level, the largest gain in
each range of ``FAN`` documents, of ``FAN`` ranges and so on: a max tree for each term, stored where it is not zero.

A query adds up weight times largest gain of its terms, an upper bound for all documents of a range. It descends from
the root of every block, the ranges with the highest bounds first; a range is opened unless its bound is below the
score of the last wanted document found so far. Ranges with an equal bound are opened, since equal scores go by doc_id.
What one block found bounds the next one that the same task holds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trisettle.llm.common import shuffle_partitions, small_batches, written

TOP = 50
#: Children of a node.
FAN = 16
#: A block ends at so many documents or postings.
BLOCK_DOCUMENTS = 1 << 14
BLOCK_POSTINGS = 1 << 20
#: Nodes that one step opens.
WAVE = 32
#: Items of a block of queries.
ITEMS = 500
#: Bits of the filter that spares most documents' terms that no item has; it grows with nothing.
FILTER_BITS = 1 << 20
#: A-Z lower-cased, what is no term blank; bytes from 0x80 are parts of characters that terms are made of.
TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
LEVELS = "array<array<int>>"
INDEX = f"block long, ids array<long>, terms array<binary>, ends {LEVELS}, nodes {LEVELS}, tops {LEVELS}"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_TERMS).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its terms once; rows with one item_id are one item."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            terms = [list(dict.fromkeys(terms_of(text.as_py()))) for text in batch.column(1)]
            at = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([t for row in terms for t in row], pa.binary())], ["item_id", "term"])

    return small_batches(items.select(F.col("item_id").cast("long"), "text")).mapInArrow(batches, "item_id long, term binary").distinct()


def outlines(docs: DataFrame, wanted: bytes) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms that may be an item's, with their counts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                n.append(len(found))
                for term, count in Counter(found).items():
                    bit = zlib.crc32(term) % FILTER_BITS
                    if wanted[bit >> 3] >> (bit & 7) & 1:
                        terms.append(term)
                        counts.append(count)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                                              pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(batches, "doc_id long, n long, terms array<binary>, counts array<int>")


def tree(term: np.ndarray, doc: np.ndarray, gain: np.ndarray, terms: int, size: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(ends by term, nodes, largest gains) of every level, documents first, up to one root; term and doc ascend."""
    ends, nodes, tops = [], [], []
    while True:
        ends.append(np.searchsorted(term, np.arange(terms), side="right").astype(np.int32))
        nodes.append(doc.astype(np.int32))
        tops.append(gain.astype(np.int32))
        if size == 1:
            return ends, nodes, tops
        size = -(-size // FAN)
        key = term * size + doc // FAN
        first = np.flatnonzero(np.diff(key, prepend=-1))
        gain = np.maximum.reduceat(gain, first) if len(first) else gain
        term, doc = key[first] // size, key[first] % size


def blocks(outline: DataFrame, documents: int, total: int) -> DataFrame:
    """The index: consecutive rows of a task's input make a block, so nothing is shuffled. A document's m counts its
    length against the mean; its gain for a term is (1000000000 tf) div (1000 tf + 20 m)."""

    def indexed(number: int, ids: list, lengths: list[int], terms: list, counts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(c) for c in counts]
        flat = pa.concat_arrays(terms).dictionary_encode()
        names = flat.dictionary
        order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term, doc, tf = rank[flat.indices.to_numpy()], np.repeat(np.arange(len(ids)), sizes), np.concatenate(counts).astype(np.int64)
        m = np.array([50 + 50 * n * documents // max(total, 1) for n in lengths], object)
        fits = bool((m < 1 << 40).all())
        gain = 1_000_000_000 * tf // (1_000 * tf + 20 * m[doc].astype(np.int64)) if fits else np.array([1_000_000_000 * int(t) // (1_000 * int(t) + 20 * k) for t, k in zip(tf, m[doc], strict=True)], np.int64)
        by = np.lexsort((doc, term))
        levels = tree(term[by], doc[by], gain[by], len(names), len(ids))
        values = [number, ids, names.take(pa.array(order)), *levels]
        ints = pa.list_(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), ints, ints, ints), strict=True)],
                                          ["block", "ids", "terms", "ends", "nodes", "tops"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, ([], [], [], [])
        postings = 0
        for batch in source:
            for at, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                counts = batch.column(3)[at].values
                if not len(counts):
                    continue
                for values, value in zip(held, (doc, n, batch.column(2)[at].values, counts.to_numpy()), strict=True):
                    values.append(value)
                postings += len(counts)
                if len(held[0]) >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                    yield indexed(number, *held)
                    number, held, postings = number + 1, ([], [], [], []), 0
        if held[0]:
            yield indexed(number, *held)

    return outline.select("doc_id", "n", "terms", "counts").mapInArrow(batches, INDEX)


class Found:
    """The best documents of one item so far: scores, highest first, and ids; a null id counts as the largest."""

    def __init__(self) -> None:
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self, top: int) -> int:
        return int(self.score[top - 1]) if len(self.score) >= top else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray, top: int) -> None:
        score, null, ids = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, ids])
        best = np.lexsort((ids, null, -score))[:top]
        self.score, self.null, self.id = score[best], null[best], ids[best]


class Block:
    """An index row, ready to be searched."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        ids = batch.column("ids")[i].values
        self.null, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.rows = {term: at for at, term in enumerate(batch.column("terms")[i].values.to_pylist())}
        levels = {name: batch.column(name)[i].values for name in ("ends", "nodes", "tops")}
        self.levels, size = [], len(self.ids)
        for level in range(len(levels["ends"])):
            ends, nodes, tops = (levels[name][level].values.to_numpy() for name in ("ends", "nodes", "tops"))
            term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            self.levels.append((term * size + nodes, tops, size))
            size = -(-size // FAN)

    def children(self, level: int, parents: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of ``level`` below ``parents`` (None: all) that hold a term, and their bounds."""
        keys, tops, size = self.levels[level]
        low = (rows[:, None] * size + (parents * FAN)[None, :]).reshape(-1)
        high = (rows[:, None] * size + np.minimum(parents * FAN + FAN, size)[None, :]).reshape(-1)
        begin, count = np.searchsorted(keys, low), 0
        count = np.searchsorted(keys, high) - begin
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        nodes, value = keys[at] % size, np.repeat(np.repeat(weights, len(parents)), count) * tops[at]
        different, place = np.unique(nodes, return_inverse=True)
        bound = np.zeros(len(different), np.int64)
        np.add.at(bound, place, value)
        return different, bound

    def search(self, terms: list[tuple[bytes, int]], found: Found, top: int) -> int:
        """Adds the block's best documents to ``found``; returns how many nodes were opened."""
        held = [(self.rows[term], weight) for term, weight in terms if term in self.rows]
        if not held:
            return 0
        rows, weights = (np.array(x, np.int64) for x in zip(*held, strict=True))
        last = len(self.levels) - 1
        bound = int((weights * self.levels[last][1][np.searchsorted(self.levels[last][0], rows)]).sum())
        if not last:
            if bound >= found.least(top):
                found.add(np.array([bound]), self.null[:1], self.ids[:1], top)
            return 0
        waiting: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in self.levels]
        waiting[last] = [np.array([0]), np.array([bound])]
        opened = 0
        while True:
            least = found.least(top)
            best = max(range(1, last + 1), key=lambda k: waiting[k][1].max(initial=-1))
            nodes, bounds = waiting[best]
            if bounds.max(initial=-1) < least:
                return opened
            order = np.lexsort((nodes, -bounds))
            order = order[bounds[order] >= least]
            now, later = order[:WAVE], order[WAVE:]
            waiting[best] = [nodes[later], bounds[later]]
            opened += len(now)
            below, value = self.children(best - 1, np.sort(nodes[now]), rows, weights)
            keep = value >= least
            below, value = below[keep], value[keep]
            if best == 1:
                found.add(value, self.null[below], self.ids[below], top)
            else:
                waiting[best - 1] = [np.concatenate(pair) for pair in zip(waiting[best - 1], (below, value), strict=True)]


def weighted(terms: DataFrame, outline: DataFrame, documents: int) -> DataFrame:
    """item_id, term and its weight floor(1000 ln((2 N + 2) / (2 df + 1))), for terms that documents hold; documents are
    counted before the shuffle."""
    df = outline.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = (F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))
    return terms.join(df, "term").select("item_id", "term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("weight"))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``top`` documents with a score above 0.

    Null texts have no term. Documents without an id are ranked, after others with their score; repeated rows are
    documents of their own. Rows with one item_id are one item with the terms of all of them. Other columns are ignored;
    without documents or items the result is empty."""
    spark = docs.sparkSession
    terms = written(item_terms(items), "item-terms")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in terms.select(F.pmod(F.crc32("term"), F.lit(FILTER_BITS)).alias("bit")).distinct().toLocalIterator():
        bits[row.bit >> 3] |= 1 << (row.bit & 7)
    outline = written(outlines(docs, bits.tobytes()), "outlines")
    counts = outline.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    index = written(blocks(outline, counts.documents, counts.total), "lexical-blocks")
    weights = written(weighted(terms, outline, counts.documents), "item-weights")
    groups = max(1, -(-weights.select("item_id").distinct().count() // ITEMS))
    lanes = shuffle_partitions(spark)
    by_item = weights.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    queries = (by_item.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
               .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))))
    sent = index.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # merged, not broadcast: the queries stand once for every lane
    pairs = sent.join(queries.withColumn("part", F.col("part").cast("int")).hint("merge"), ["part", "lane"]).select("part", "ids", "terms", "ends", "nodes", "tops", "items")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items, found = None, [], []

        def best() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(items)), [len(f.score) for f in found])
            empty = [np.zeros(0, np.int64)]
            null = np.concatenate([np.zeros(0, bool), *[f.null for f in found]])
            return pa.RecordBatch.from_arrays([pa.array([items[i][0] for i in at], pa.int64()), pa.array(np.concatenate(empty + [f.id for f in found]), mask=null), pa.array(np.concatenate(empty + [f.score for f in found]))],
                                              ["item_id", "doc_id", "score"])

        for batch in source:
            for i in range(batch.num_rows):
                if batch.column("part")[i].as_py() != part:
                    if found:
                        yield best()
                    part = batch.column("part")[i].as_py()
                    items = [(row["item_id"], [(bytes(t["term"]), t["weight"]) for t in row["terms"]]) for row in batch.column("items")[i].as_py()]
                    found = [Found() for _ in items]
                block = Block(batch, i)
                for (_, wanted), own in zip(items, found, strict=True):
                    block.search(wanted, own, top)
        if found:
            yield best()

    near = pairs.mapInArrow(batches, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def oracle(top: int = TOP) -> str:
    """The same in SQL, by scoring every document for every item."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(lower)
    return f"""with words as (select doc_id, unnest({found}) as term from documents),
tfs as (select doc_id, term, count(*) as tf from words group by doc_id, term),
lengths as (select doc_id, count(*) as n from words group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
wanted as (select distinct item_id, unnest({found}) as term from benchmark),
weights as (select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tfs, total group by term),
scores as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
  from wanted join weights using (term) join tfs using (term) join lengths using (doc_id), total group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0
qualify rank <= {top}"""
