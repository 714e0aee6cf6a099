"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are the hashes of a document's distinct word shingles. Of tokens in one global order, two sets of Jaccard
similarity t or more share a token among their first n - ceil(t n) + 1. The order used here puts a set F of frequent
tokens last and goes by hash otherwise:

* F comes from counts within chunks of documents over all tokens, summed; at most ``MOST_FREQUENT`` tokens, those
  with the highest counts. Any set F gives the same result, a good one only saves candidates.
* A document extends its prefix over frequent tokens until it has n - ceil(t n) + 1 other ones, and indexes those one
  by one.
* A document without so many has its other tokens one by one and its frequent ones, rarest first, in combinations of
  two that follow each other. Two such documents that are similar share c = (|x| + |y|) * 2 / 7 - 1 or more of these
  signatures, as a missing token breaks two combinations and an additional one breaks one. So, by the prefix
  principle once more, each indexes all but the last c - 1 of its signatures, which are the most frequent ones.

Pairs that share too few signatures for the similarity are dropped by a bound that loses none (``may_link``);
the others are verified on the whole token sets. A component needs no link of every pair: each document is first
held against the first document of the signature groups it is in, the one it shares most with; then pairs that
share a signature and are still in different components are verified, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import row_key, small_batches, written
from trisettle.llm.components import components
from trisettle.llm.shingles import BASE, mixed, shingles

#: Tokens in F at most: 16 bytes each go to every executor.
MOST_FREQUENT = 500_000
#: Summed count from which a token is frequent; documents of a chunk in which a token must occur to be counted.
FREQUENT = 16
IN_CHUNK = 2
#: Tokens of a chunk.
CHUNK = 1_000_000
#: Rows of a batch that a Python task takes at once, so that neither side holds large batches of results.
SLICE = 500
EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
#: Bits of the filter that spares most documents a second look; one document sets one bit.
FILTER_BITS = 1 << 22
#: The same for rows that may be spare: 131,072 words, which are broadcast.
ROW_BITS = 1 << 23


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Prefix length for similarity 3/4: n - ceil(3 n / 4) + 1."""
    return n // 4 + 1


def sliced(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def outlined(docs: DataFrame, size: int) -> DataFrame:
    """One row for each document (kind 0: value is its id, n, and two hashes of its set), and rows for tokens that
    recur in a chunk (kind 1: value is the token, n its count)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[np.ndarray] = []
        held = 0

        def recurring() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(chunk), return_counts=True)
            keep = counts >= IN_CHUNK
            n = int(keep.sum())
            zero = np.zeros(n, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), as_signed(tokens[keep]), pa.array(counts[keep].astype(np.int64)), pa.array(zero), pa.array(zero)], ["kind", "value", "n", "h1", "h2"])

        for batch in sliced(source):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingles(text.as_py(), size)
                h1 = int(tokens.sum(dtype=np.uint64)) if len(tokens) else 0
                h2 = int(mixed(tokens).sum(dtype=np.uint64)) if len(tokens) else 0
                rows.append((doc, len(tokens), h1, h2))
                chunk.append(tokens)
                held += len(tokens)
                if held >= CHUNK:
                    yield recurring()
                    chunk, held = [], 0
            ids, n, h1, h2 = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), as_signed(np.array(h1, np.uint64)), as_signed(np.array(h2, np.uint64))], ["kind", "value", "n", "h1", "h2"])
        if chunk:
            yield recurring()

    return docs.mapInArrow(batches, "kind int, value long, n long, h1 long, h2 long")


def frequent(outline: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """F, sorted, and each token's count; at most ``MOST_FREQUENT`` tokens reach the driver."""
    counts = outline.filter("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "value").limit(MOST_FREQUENT).toArrow()
    tokens, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def members(outline: DataFrame) -> DataFrame:
    """doc_id, n and the smallest doc_id with the same set."""
    docs = outline.filter("kind = 0").select(F.col("value").alias("doc_id"), "n", "h1", "h2")
    first = docs.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class_id"))
    return docs.join(first, ["n", "h1", "h2"]).select("doc_id", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def signatures(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """signature (even: a token, odd: a combination), doc_id, n and loose of every document with words: -1 where it
    has a full prefix of single tokens, else the number of its single tokens and, in the low 32 bits, the place of
    the signature in its order."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def units(tokens: np.ndarray) -> tuple[np.ndarray, int]:
        often, counts = shared.value
        rest = tokens[:0]
        if len(often):
            place = np.searchsorted(often, tokens)
            place[place == len(often)] = 0
            common = often[place] == tokens
            rest = tokens[common][np.lexsort((tokens[common], counts[place[common]]))]
            tokens = tokens[~common]
        n = len(tokens) + len(rest)
        if len(tokens) >= needed(n):
            return tokens[: needed(n)] & EVEN, -1
        pairs = mixed(rest[:-1] * np.uint64(BASE) + rest[1:]) | np.uint64(1)
        least = max(1, -(-(2 * (n + -(-3 * n // 4)) - 7) // 7))  # c for the smallest partner
        return np.concatenate((tokens & EVEN, pairs[: max(1, len(pairs) - least + 1)])), len(tokens)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(source):
            found, ids, sizes, rest = [np.zeros(0, np.uint64)], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingles(text.as_py(), size)
                own, loose = units(tokens) if len(tokens) else (tokens, -1)
                found.append(own)
                rest.append(np.full(len(own), -1, np.int64) if loose < 0 else (loose << 32) + np.arange(len(own)))
                ids.append(np.full(len(own), doc, np.int64))
                sizes.append(np.full(len(own), len(tokens), np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([as_signed(np.concatenate(found)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rest))], ["signature", "doc_id", "n", "loose"])

    return docs.mapInArrow(batches, "signature long, doc_id long, n int, loose long")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every id of ``ids`` sets a bit; only its words reach the driver."""
    bit = F.pmod(F.col("doc_id"), F.lit(FILTER_BITS))
    words = ids.select((bit / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def token_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and tokens of the documents in ``ids``: a filter spares most others the hashing, a join the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in sliced(source):
            known = batch.column(0).to_numpy() % FILTER_BITS
            keep = np.flatnonzero(bits[known >> 5] >> (known & 31) & 1)
            sets = [shingles(batch.column(1)[int(i)].as_py(), size).view(np.int64) for i in keep]
            ends = np.cumsum([0, *map(len, sets)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), tokens], ["doc_id", "tokens"])

    return docs.mapInArrow(batches, "doc_id long, tokens array<long>").join(ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b), a written table, with the number of common tokens and whether they are similar."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "paired")
    sets = written(token_sets(docs, ids, size), "token-sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return both.select("a", "b", "common", F.expr("4 * common >= 3 * (total - common)").alias("similar"))


def may_link() -> Column:
    """Whether (n_a, loose_a), (n_b, loose_b) allow the similarity with ``common`` shared signatures.

    Similar sets share o = ceil(3 (n_a + n_b) / 7) tokens or more. Of two documents with full prefixes, the one whose
    prefix ends first finds each of its prefix tokens that the other has in the other's prefix, so at most n - o of
    them are not shared; a full prefix always ends before one that is not. Of two that are not full nothing more
    than one shared signature is known.
    """
    total = F.col("n_a") + F.col("n_b")
    shared = F.ceil(3 * total / 7)

    def least(side: str) -> Column:
        n = F.col(f"n_{side}")
        return F.floor(n / 4) + 1 - n + shared

    full_a, full_b = F.col("loose_a") < 0, F.col("loose_b") < 0
    both = F.least(least("a"), least("b"))
    bound = (F.when(full_a & full_b, both).when(full_a, least("a")).when(full_b, least("b"))
             .otherwise(1))
    return (F.col("common") >= bound) & sized()


def sized() -> Column:
    """Whether the sizes allow the similarity."""
    return (4 * F.col("n_a") >= 3 * F.col("n_b")) & (4 * F.col("n_b") >= 3 * F.col("n_a"))


def fullness(loose: str) -> Column:
    """-1 with a full prefix, 0 without."""
    return F.when(F.col(loose) < 0, -1).otherwise(0)


def meetings(rows: DataFrame) -> DataFrame:
    """Rows of different components that meet in a signature and may still be similar."""
    one, other = (rows.select("signature", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "loose", "own", "pivot", "inside", "component")]) for side in "ab")
    # two documents without full prefixes share none of their own tokens, and o = 3 (n_a + n_b) / 7 or more of the rest;
    # around one pivot, what they share is inside it for both or outside it for both
    rest = lambda side: F.col(f"n_{side}") - F.col(f"own_{side}")
    most = F.least(rest("a"), rest("b"))
    inside = F.least("inside_a", "inside_b") + F.least(rest("a") - F.col("inside_a"), rest("b") - F.col("inside_b"))
    most = F.when(F.col("pivot_a") == F.col("pivot_b"), F.least(most, inside)).otherwise(most)
    total = F.col("n_a") + F.col("n_b")
    # the first signature that the two share has c - 1 shared ones behind it in either's n - 1. Own tokens break no
    # combination, so of combinations more are shared: each missing frequent token breaks two, each additional one one
    o = F.ceil(3 * total / 7)
    c = F.greatest(3 * o - total - 1, F.lit(1))
    singles = lambda side: F.shiftright(f"loose_{side}", 32)
    chain = 3 * o - total - 1 + F.col("own_a") + F.col("own_b") + F.greatest(F.col("own_a") - singles("a"), F.col("own_b") - singles("b"))
    c = F.when(F.col("signature") % 2 == 0, c).otherwise(F.greatest(c, chain))
    early = lambda side: F.col(f"loose_{side}").bitwiseAND(F.lit(0xFFFFFFFF)) <= F.col(f"n_{side}") - 1 - c
    shareable = (F.col("loose_a") < 0) | (F.col("loose_b") < 0) | ((7 * most >= 3 * total) & early("a") & early("b"))
    return one.join(other, "signature").filter("doc_id_a < doc_id_b and component_a <> component_b").filter(shareable & sized())


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; see the module for what links.

    A null or empty text has no shingles and is linked with nothing; rows with equal sets are one class and always
    linked; a repeated doc_id is returned for each of its rows; extra columns are ignored; an empty table gives an
    empty result; texts are taken whole. A
    row without doc_id is only compared for equal sets: its component is that of its class, else null.
    """
    texts = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    outline = written(outlined(texts, size), "shingle-outline")
    texts = texts.filter("doc_id is not null")
    known = written(members(outline), "shingle-classes")
    copies = written(known.filter("class_id <> doc_id or n = 0").select("doc_id").distinct(), "copies")
    originals = texts.join(copies, "doc_id", "left_anti")
    units = written(signatures(originals, frequent(outline), size), "signatures")
    # the first document of a group: the smallest doc_id, or of those without full prefixes the one nearest to the others
    rank = F.when(F.col("loose") < 0, F.col("doc_id")).otherwise(F.shiftright("loose", 32) * F.lit(1 << 40) + F.pmod("doc_id", F.lit(1 << 40)))
    groups = units.groupBy("signature").agg(F.count("*").alias("members"), F.min_by("doc_id", rank).alias("first")).filter("members > 1").select("signature", "first")
    # written first: a join of two exchanges can be split where a signature is very common, one above an aggregate can't
    groups = written(groups, "signature-groups")
    shared = written(units.join(groups, "signature").select("signature", "doc_id", "n", "loose", "first"), "shared-signatures")

    stars = (shared.filter("doc_id <> first").groupBy(F.col("doc_id").alias("b"), "first").agg(F.count("*").alias("common"))
             .groupBy("b").agg(F.max_by("first", F.struct("common", -F.col("first"))).alias("a")))
    flat = shared.withColumn("loose", fullness("loose"))
    ours, theirs = (flat.select("signature", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "loose")]) for side in "ba")
    tried = (stars.join(ours, F.col("b") == F.col("doc_id_b")).join(theirs.withColumnRenamed("doc_id_a", "a"), ["a", "signature"])
             .groupBy("a", "b", "n_a", "n_b", "loose_a", "loose_b").agg(F.count("*").alias("common")).filter(may_link()))
    tried = written(tried.select("a", "b", "n_a", "loose_a"), "stars")
    checked = written(verified(tried.select("a", "b"), texts, size), "checked-stars")
    edges = checked.filter("similar").select("a", "b")
    labels = components(edges)

    # single tokens that no other document without a full prefix has either
    own = shared.filter("loose >= 0").groupBy("doc_id").agg((F.shiftright(F.max("loose"), 32) - F.count_if(F.col("signature") % 2 == 0)).alias("own"))
    own = written(own.filter("own > 0"), "own-tokens")
    # what documents share with their first document, where that has no full prefix either; a first one holds all of its own
    firsts = tried.filter("loose_a >= 0")
    around = checked.join(firsts.select("a", "b"), ["a", "b"]).select(F.col("b").alias("doc_id"), F.col("a").alias("pivot"), F.col("common").alias("inside"))
    centres = firsts.select(F.col("a").alias("doc_id"), F.col("a").alias("pivot"), F.col("n_a").alias("inside")).distinct()
    around = written(around.union(centres.join(around, "doc_id", "left_anti")), "pivots")
    placed = (shared.join(labels, F.col("doc_id") == F.col("node"), "left").join(own, "doc_id", "left").join(around, "doc_id", "left")
              .select("signature", "doc_id", "n", "loose", "pivot", "inside", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("component", "doc_id").alias("component")))
    placed = written(placed, "placed-signatures")
    mixed_groups = written(placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("signature"), "mixed-groups")
    open_rows = written(placed.join(mixed_groups, "signature"), "open-signatures")
    pairs = (meetings(open_rows).groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "n_a", "n_b", fullness("loose_a").alias("loose_a"), fullness("loose_b").alias("loose_b"))
             .agg(F.count("*").alias("common")).filter(may_link()))
    more = verified(written(pairs.join(tried, ["a", "b"], "left_anti").select("a", "b"), "pairs"), texts, size)
    more = written(more.filter("similar").select("a", "b"), "links")
    if not more.isEmpty():
        labels = components(edges.union(more))
    return (known.join(labels, known.class_id == labels.node, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key, null keys last.

    Rows are told apart by key and text, so two texts of one key are judged each, and of repeated rows one stays.
    Whatever ``linked`` links is one group; rows without words are linked with nothing but their repetitions.
    """
    keyed = docs.withColumn("_row", row_key(key, text))
    groups = linked(keyed, "_row", text, size).groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("group"), F.count("*").alias("n"))
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("_row"))
    first = keyed.select("_row", order.alias("order")).distinct().join(groups, "_row").groupBy("group").agg(F.min(F.struct("order", "_row", "n")).alias("first"))
    kept = written(first.select("first._row", "first.n"), "kept-rows")
    # most rows stay and the rest mostly goes, and texts must not be shuffled to tell which: rows whose bit is not set in
    # a bitmap of those that may go stay; of the others, those not in a bitmap of kept rows with such a bit go. Only
    # what hits both, kept rows by chance and repeated ones, is joined
    doubtful = groups.join(kept.filter("n = 1").select("_row"), "_row", "left_anti").select("_row")
    may_go = bitmap(doubtful, F.col("_row"))
    other_key = F.xxhash64("_row")
    may_stay = bitmap(looked_up(kept, may_go, F.col("_row")).filter("_hit").select("_row"), other_key)
    first_look = looked_up(keyed, may_go, F.col("_row"))
    rest = looked_up(first_look.filter("_hit").drop("_hit"), may_stay, other_key).filter("_hit").drop("_hit")
    single = rest.join(kept.filter("n = 1").select("_row"), "_row", "left_semi")
    repeated = rest.join(kept.filter("n > 1").select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
    return first_look.filter("not _hit").drop("_hit").unionByName(single).unionByName(repeated).select(*docs.columns)


def bitmap(rows: DataFrame, key: Column) -> DataFrame:
    """``_word`` and its ``_bits``: each row sets one of ``ROW_BITS`` bits by its 64-bit key, so the table has at most
    ``ROW_BITS`` / 64 rows whatever it is made of."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    return written(rows.select(word_of(key).alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits")), "row-bitmap")


def looked_up(rows: DataFrame, bits: DataFrame, key: Column) -> DataFrame:
    """``rows`` with ``_hit``: whether the bit of their key is set, which it is for every row that set it."""
    found = rows.withColumn("_word", word_of(key)).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("_hit", F.coalesce(F.getbit("_bits", F.pmod(key, F.lit(64)).cast("int")), F.lit(0)) == 1).drop("_word", "_bits")


def word_of(key: Column) -> Column:
    return F.floor(F.pmod(key, F.lit(ROW_BITS)) / 64).cast("int")
